"""Queries that no other test calls, against plain versions on the smallest given tables."""

import zlib
from collections import defaultdict

import brute
import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from barwright.llm import quality, queries

SF = "/root/testdata/sf0.001"


def packed(tokenizer, texts):
    """doc_id -> ids with the end id, as one list."""
    return {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, queries.END_ID] for i, t in texts.items()}


def test_packing_of_the_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    whole = packed(Tokenizer.from_file(queries.tokenizer_path()), texts)
    rows, held = queries.op4_packing(spark, SF).collect(), defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        ids = whole[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4"))
        held[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for doc_id, parts in held.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == len(whole[doc_id])
    assert set(held) == set(whole)
    for sequence, parts in places.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == queries.SEQUENCE or sequence == max(places)


def test_pipeline_equals_its_plain_version(spark):
    """run() on the smallest given documents, stage by stage in plain Python; the model alone is the operator's own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.quality_model(spark, docs, SF)
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    def score(text):
        words = (text or "").split()
        used = [f for w in words for f in quality.features(w)] + quality.pair_buckets(np.array([quality.word_hash(w) for w in words], np.uint64)).tolist()
        logit = (model.weights[used].mean() if used else 0.0) + model.bias
        return 1 / (1 + np.exp(-logit))

    rows = [(i, t) for i, t in rows if score(t) >= corpus_pipeline.LEAST_QUALITY]
    lines = brute.line_dedup(rows)
    rows = [(i, lines[i][2] if t is not None else None) for i, t in rows]
    sets = {i: brute.shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    names = sorted(sets)
    for n, i in enumerate(names):
        for j in names[n + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= corpus_pipeline.LEAST_LIKENESS * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    rows = [(i, t) for i, t in rows if top(i) == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.decontaminate(rows, items)
    rows = {i: t for i, t in rows if not found[i][3]}
    whole = packed(Tokenizer.from_file(queries.tokenizer_path()), rows)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == set(whole)
    ids = defaultdict(dict)
    for r in pieces:
        ids[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    for doc_id, want in whole.items():
        assert [x for at in sorted(ids[doc_id]) for x in ids[doc_id][at]] == want
