import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm import language_id, line_dedup, near_dedup, pii, quality
from barwright.llm.decontamination import decontaminate
from barwright.llm.line_dedup import dedup_lines
from barwright.llm.near_dedup import components, near_duplicates, plan
from barwright.llm.packing import pack
from barwright.llm.queries import tokenizer_path

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu".split() for b in "ran sel tim von wux".split()]


def sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (4, "word"), (None, "no id here but some words to read"), (6, "x" * 200_000), (7, "Ünïcode ß İ 日本語 \U0001f600 text")]


# personal data

PII = [
    "mail a.b+c@ex-ample.co.uk, x@y and a@b@c.de; me@a.b.c. then%d@e.f",
    "ips 1.2.3.4 256.1.1.1 01.002.3.255 1.2.3.4.5.6.7.8 1.2.3 999.1.1.1.1",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111 1 12345678901234567890",
    "phones +1 (171) 555-2028, +49.30.1234567 +1 +12 3 +123456789012345678 ++1 555 123 45-",
    "é" * 30 + " +1 (171) 555-2028 \U0001f600 z@q.io",
    "1" * 5000 + " " + "a" * 5000 + "@",
    "9 " * 4000,
    "a.b" * 3000 + "@" + "c." * 3000 + "d",
]


def test_pii_base_spans_equal_the_patterns(spark, documents):
    rows = [*EDGES, *((10 + i, t) for i, t in enumerate(PII))]
    found = pii.find_spans(documents(rows, extra=False)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(s.kind, s.start, s.stop) for s in r.spans if s.kind != "term"] == brute.base_spans(r.text)


def test_pii_many_matches_stay_exact(spark, documents):
    text = " ".join(f"u{i}@h{i % 7}.org" for i in range(3000))
    (row,) = pii.find_spans(documents([(1, text)], extra=False)).collect()
    assert [(s.kind, s.start, s.stop) for s in row.spans] == brute.base_spans(text)


def test_pii_terms_that_reveal_an_entity(spark, documents):
    r = random.Random(3)
    rows = [(i, sentence(r, 40)) for i in range(60)]
    rows += [(100 + i, f"{sentence(r, 12)} Zorblatt writes from z@corp.example often {sentence(r, 12)}") for i in range(4)]
    rows += [(200, "Nobody but zorblatt was there."), (201, "mail z@corp.example for more"), (202, "common words from often")]
    found = {x.doc_id: x for x in pii.sanitise(documents(rows, extra=False)).collect()}
    assert [(s.kind, s.start, s.stop) for s in found[200].spans] == [("term", 11, 19)]
    assert found[200].sanitised == "Nobody but [term] was there."
    assert found[201].sanitised == "mail [email] for more"
    assert all(not found[i].spans for i in range(60))
    assert all("z@corp" not in found[100 + i].sanitised and "Zorblatt" not in found[100 + i].sanitised for i in range(4))
    assert pii.sanitise(documents([], extra=False)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_pii_terms_equal_the_plain_counts(spark, documents, seed):
    """Term spans of random small corpora against counts over sets of documents, and again with rows repeated many times."""
    r = random.Random(seed)
    mails = [f"m{i}@corp.org" for i in range(4)]
    rows = []
    for i in range(60):
        words = [r.choice(WORDS[:25]) for _ in range(8)]
        if i % 2:
            who = i % 8 // 2
            words[3:3] = [f"Name{who}" if r.random() < 0.9 else "someone", mails[who], "said"]
        elif r.random() < 0.1:
            words.append(f"name{r.randrange(4)}")
        rows.append((i, " ".join(words)))
    disclosing = brute.disclosing(rows, pii.DISCLOSES, pii.SUPPORT)
    expected = {i: brute.term_spans(text, disclosing) for i, text in rows}
    assert any(expected.values())
    for more in (rows, rows + [rows[1]] * 40 + [rows[2]] * 7):
        found = pii.find_spans(documents(more, extra=False).repartition(3)).collect()
        assert len(found) == len(more)
        for x in found:
            assert [(s.start, s.stop) for s in x.spans if s.kind == "term"] == expected[x.doc_id]


def test_pii_columns_of_the_same_names_are_replaced(spark, documents):
    df = documents([(1, "mail a@b.org"), (2, None)]).withColumn("sanitised", F.lit(3))
    found = {x.doc_id: x for x in pii.sanitise(df).collect()}
    assert found[1].sanitised == "mail [email]" and found[1].spans[0].kind == "email" and found[1].kept == "mine"
    assert found[2].sanitised is None and found[2].spans == []


def test_pii_terms_at_the_ends_of_texts_and_of_any_length(spark, documents):
    people = ["Jonathan", "Li", "王芳", "k9x2", "n" * 60]
    rows, i = [], 0
    for p, name in enumerate(people):
        for k in range(4):
            rows += [(i, f"{name} <p{p}@mail.org> asked about topic{p}v{k}"), (i + 1, f"call{p}v{k} of p{p}@mail.org by {name}")]
            i += 2
    rows += [(i + k, f"plain words number{k} of asked about call by") for k in range(400)]
    found = {x.doc_id: x for x in pii.find_spans(documents(rows, extra=False)).collect()}
    for n, (doc_id, text) in enumerate(rows[: 8 * len(people)]):
        marked = [text[s.start : s.stop] for s in found[doc_id].spans if s.kind == "term"]
        assert people[n // 8] in marked, text
    assert not any(s.kind == "term" for doc_id, _ in rows[8 * len(people) :] for s in found[doc_id].spans)


def test_pii_words_cut_by_the_context_are_no_terms(spark):
    long = "ab " * 60
    cases = [("Ann <a@b.org> Bo", ["ann", "bo"]), ("Xa@b.org Bo", ["bo"]), (f"Zed{long}a@b.org", None), (f"{long}a@b.org {long}", None), ("w" * 170 + " a@b.org", [])]
    rows = pii.with_base_spans(spark.createDataFrame([(t,) for t, _ in cases], "__text string")).select("__text", pii._terms(F.concat_ws(" ", "__base.words_before", "__base.words_after")).alias("t"))
    found = {r[0]: r[1] for r in rows.select("__text", "t").collect()}
    assert all(set(found[t]) == ({"ab"} if want is None else set(want)) for t, want in cases)


# lines

def lines_table():
    r = random.Random(5)
    shared = [sentence(r, 6) for _ in range(5)]
    rows = []
    for i in range(40):
        body = [sentence(r, 7) for _ in range(4)] + [" \t" + x.upper() + "\r" for x in r.sample(shared, 2)] + ["short line", "short line"]
        r.shuffle(body)
        rows.append((i, "\n".join(body)))
    return [*rows, (100, shared[0] + "\n" + shared[0]), (101, None), (102, ""), (103, "\n\n"), (104, "é" * 19), (105, "é" * 19), (106, "é" * 19), (107, "é" * 20), (108, "é" * 20), (109, "é" * 20), (110, "z" * 100_000)]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_line_dedup_equals_the_plain_one(spark, documents, limit):
    rows = lines_table()
    found = dedup_lines(documents(rows).repartition(5), into="out", broadcast_rows=limit)
    assert {r.doc_id: (r.out.n_lines, r.out.n_dropped, r.out.kept) for r in found.collect()} == brute.line_dedup(rows)
    assert found.first().h1 == 0 and found.first().kept == "mine"


def test_line_dedup_in_ranges(spark, documents):
    """Filters far too small for all lines: ranges of hashes, and suspects that are none, change nothing."""
    df = documents(lines_table()).repartition(3)
    whole, cut = (sorted(line_dedup.repeated_lines(df, most_bits=bits).collect()) for bits in (1 << 31, 1 << 8))
    assert whole == cut and whole


def test_line_dedup_of_repeated_and_empty_rows(spark, documents):
    assert dedup_lines(documents([])).count() == 0
    twice = dedup_lines(documents([(1, "a line of more than twenty"), (1, "a line of more than twenty"), (2, "a line of more than twenty"), (None, "a line of more than twenty")]))
    assert [r.lines.n_dropped for r in twice.collect()] == [0, 0, 0, 0]


# near duplicates

def near_table():
    r = random.Random(11)
    rows, n = [], 0
    for size in (6, 30, 120):
        for _ in range(4):
            base = sentence(r, size).split()
            for _ in range(5):
                words = list(base)
                for _ in range(r.randrange(0, 1 + size // 25)):
                    words[r.randrange(len(words))] = r.choice(WORDS)
                rows.append((n, " ".join(words)))
                n += 1
    rows += [(n + i, sentence(r, 5 + i)) for i in range(20)]
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one two three")]


def test_near_duplicates_equal_all_pairs(spark, documents):
    rows = near_table()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(rows).repartition(4)).collect()}
    assert found == brute.near(rows)


def test_near_duplicates_of_a_large_family(spark, documents):
    """A region of many nodes, of which some are linked only with each other, not with the region's first."""
    r = random.Random(2)
    base = sentence(r, 150).split()
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(r.randrange(0, 7)):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    found = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(documents(rows)).collect()}
    assert found == brute.near(rows)


def family(r, n, of, own):
    """n texts that share `of` words in one run and have `own` words each: alike, but not near duplicates."""
    base = [f"b{k}" for k in range(of)]
    return [[*base, *(f"o{i}x{k}" for k in range(own))] for i in range(n)]


def test_pairs_in_a_dense_family_are_found(spark, documents):
    """600 texts of a similarity of 0.6 to each other, among them 60 pairs above 0.85 that nothing else links."""
    r = random.Random(3)
    rows = []
    for i, words in enumerate(family(r, 600, 164, 53)):
        rows.append((2 * i, " ".join(words)))
        if i % 10 == 0:
            k = r.randrange(170, 205)
            rows.append((2 * i + 1, " ".join([*words[:k], f"new{i}", *words[k + 1 :]])))
    found = {x.doc_id: x.component_id for x in near_duplicates(documents(rows)).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}


def pages(r, n, sections=30, words=8):
    """n texts of one template: each keeps most of the same sections, in order, and has hardly any words of its own."""
    fixed = [" ".join(f"s{i}w{k}" for k in range(words)) for i in range(sections)]
    return [(i, " ".join([f"page{i}", *(s for s in fixed if r.random() < 0.85)])) for i in range(n)]


def _plain_components(rows, percent):
    """Components of texts by a matrix of all their shingles: quick where the texts share theirs."""
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    number = {s: i for i, s in enumerate(set().union(*sets))}
    held = np.zeros((len(rows), len(number)), np.float32)
    for i, found in enumerate(sets):
        held[i, [number[s] for s in found]] = 1
    sizes = held.sum(axis=1)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for at in range(0, len(rows), 500):
        both = held[at : at + 500] @ held.T
        for i, j in zip(*np.nonzero(100 * both >= percent * (sizes[at : at + 500, None] + sizes - both)), strict=True):
            a, b = sorted((top(at + i), top(j)))
            root[b] = a
    return {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}


def test_a_node_meets_a_bounded_number_of_others(spark, documents, monkeypatch):
    """Candidate pairs of pages of one template, which share all but their names, grow as their number does, not as its square."""
    counts = []
    plain = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *rest: (counts.append(pairs.count()), plain(pairs.limit(0), *rest))[1])
    monkeypatch.setattr(near_dedup, "least_agreement", lambda like, values: 1)
    # One turn for each number of pages.
    monkeypatch.setattr(near_dedup, "_credit", lambda depth, *rest: np.full(len(depth), -1.0))
    for n in (500, 2000):
        near_duplicates(documents(pages(random.Random(4), n))).count()
        assert 0 < counts[-1] <= n * near_dedup.ORDERS * near_dedup.NEAREST
    assert counts[-1] < 8 * counts[1]


@pytest.mark.parametrize("turns", [0, 3])
def test_pages_of_one_template(spark, documents, monkeypatch, turns):
    """Their rarest shingles are common ones: the exact join would list all pairs, so turns go on; every component is found."""
    counts = []
    plain = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "TURNS", turns)
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *rest: (counts.append(pairs.count()), plain(pairs, *rest))[1])
    listed = []
    for n in (400, 1600):
        rows = pages(random.Random(6), n)
        counts.clear()
        found = {x.doc_id: x.component_id for x in near_duplicates(documents(rows)).collect()}
        want = _plain_components(rows, 85)
        assert sum(found[i] != want[i] for i, _ in rows) <= n // 400
        listed.append(sum(counts))
    assert listed[1] < 8 * listed[0]


def test_what_turns_leave_unsettled_is_joined_exactly(spark, documents, monkeypatch):
    """Without any turn, the join on the rarest shingles alone finds the pairs of a dense family, and lists few others."""
    r, counts = random.Random(5), []
    plain = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "TURNS", 0)
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *rest: (counts.append(pairs.count()), plain(pairs, *rest))[1])
    rows = []
    for i, words in enumerate(family(r, 300, 164, 53)):
        rows.append((2 * i, " ".join(words)))
        if i % 10 == 0:
            k = r.randrange(170, 205)
            rows.append((2 * i + 1, " ".join([*words[:k], f"new{i}", *words[k + 1 :]])))
    # The forest's own candidates are passed over, so that all is left to the join.
    monkeypatch.setattr(near_dedup, "least_agreement", lambda like, values: values + 1)
    found = {x.doc_id: x.component_id for x in near_duplicates(documents(rows)).collect()}
    assert found == {i: i - i % 2 for i, _ in rows}
    assert counts[0] == 0 and counts[-1] <= 60


def test_longer_labels_are_sorted_by_short_keys():
    """Sorting by ranges samples keys into the driver's memory: they are short, and key and rest together are the whole label."""
    texts, by = ["one two three four five six", "one two three four five seven"], near_dedup.plan(85)
    columns = {"node": [1, 2], "component": [1, 2], "n": [2, 2], "text": texts, "buckets": pa.array([[0, 1], [0, 2]], pa.list_(pa.int8()))}
    (found,) = near_dedup._wide_labels(iter([pa.record_batch(columns)]), by, 5, 1)
    assert {len(x) for x in found.column("label").to_pylist()} == {1 + 2 * near_dedup.DEPTH + near_dedup.SORTED} and near_dedup.SORTED <= 64
    full = near_dedup.signature(near_dedup.shingles(texts[1].encode(), near_dedup._WordHashes()), near_dedup.WIDE, 1).astype(np.uint8)
    label, rest = found.column("label")[2 * 3 + 1].as_py(), found.column("rest")[2 * 3 + 1].as_py()
    assert label[1 + 2 * near_dedup.DEPTH :] + rest[: near_dedup.WIDE - near_dedup.SORTED] == np.roll(full, -3 * (near_dedup.WIDE // near_dedup.ORDERS)).tobytes()
    assert len(rest) == near_dedup.WIDE - near_dedup.SORTED + near_dedup.BUCKETS


def test_rows_met_before_share_no_known_depth_beyond_what_is_sorted():
    """Rows alike in all sorted values say nothing about deeper ones, even where those differ."""
    values = np.zeros((near_dedup.NEAREST + 1, near_dedup.SORTED + 8), np.uint8)
    values[:, near_dedup.SORTED + 2] = np.arange(len(values))
    depth = near_dedup._met_before(values, np.zeros(len(values), int) + 1, np.arange(len(values)), 7)[2]
    assert depth[-1] == 1 + values.shape[1]


def test_rows_met_before_equal_a_plain_search():
    r = np.random.default_rng(8)
    for components_, regions in ((3, 2), (40, 3), (200, 1), (1, 1)):
        n = 300
        region = np.sort(r.integers(0, regions, n))
        component = r.integers(0, components_, n)
        component[100:180] = 0
        values = r.integers(0, 2, (n, 12)).astype(np.uint8)
        i, j, depth = near_dedup._met_before(values, region, component, 7)
        want = set()
        for row in range(n):
            others = [k for k in range(row - 1, -1, -1) if region[k] == region[row] and component[k] != component[row]][: near_dedup.NEAREST]
            want |= {(row, k) for k in others if (values[row] == values[k]).sum() >= 7}
            if len(others) == near_dedup.NEAREST:
                same = values[row] == values[others[-1]]
                assert depth[row] == 1 + (12 if same.all() else int(same.argmin()))
            else:
                assert depth[row] == (0 if region[row] > region[0] else -1)
        assert set(zip(i.tolist(), j.tolist())) == want
        # What is held for later rows gives them the same neighbours.
        near = near_dedup._still_near(component)
        for c in range(components_ + 1):
            assert [k for k in near[::-1] if component[k] != c][: near_dedup.NEAREST] == [k for k in range(n - 1, -1, -1) if component[k] != c][: near_dedup.NEAREST]


def test_sets_have_no_more_in_common_than_their_buckets():
    r = np.random.default_rng(9)
    base = r.integers(0, 1 << 63, 90_000, dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(r.choice(base, size)) for size in (1, 40, 300, 5_000, 90_000, 120_000)]
    counts = np.array([np.bincount((s >> np.uint64(56)).astype(int), minlength=near_dedup.BUCKETS) for s in sets])
    sizes, beyond = np.minimum(counts, 255).astype(np.uint8), np.maximum(counts - 255, 0).sum(axis=1)
    assert beyond[-1] > 0
    i, j = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    most = near_dedup._most_in_common(sizes, beyond, i, j)
    for a, b, bound in zip(i, j, most, strict=True):
        assert len(np.intersect1d(sets[a], sets[b])) <= bound <= min(len(sets[a]), len(sets[b]))
    assert len(near_dedup._most_in_common(sizes, beyond, i[:0], j[:0])) == 0


def test_one_id_with_several_texts(spark, documents):
    """Texts under one id are documents of their own: 5 has a text near 1's, and one that nothing is near."""
    r = random.Random(9)
    a, b = sentence(r, 80), sentence(r, 80)
    near = a.split()
    near[3] = "other"
    rows = [(1, a), (5, " ".join(near)), (5, b), (5, b), (7, b), (8, None), (8, "x y")]
    found = near_duplicates(documents(rows)).collect()
    text_of = {x.text_hash: t for (_, t), x in zip(rows, documents(rows).select(F.xxhash64("text").alias("text_hash")).collect())}
    got = sorted((x.doc_id, str(text_of[x.text_hash])[:9], x.component_id, x.kept) for x in found)
    assert got == sorted((i, str(t)[:9], c, k) for (i, t), c, k in zip(rows, [1, 1, 5, 5, 5, 8, 8], [True, False, True, True, False, True, True]))
    stay = corpus_pipeline.near_stage(spark, documents(rows), "").collect()
    assert sorted((x.doc_id, str(x.text)) for x in stay) == sorted([(1, a), (5, b), (8, "None"), (8, "x y")])
    assert stay[0].h1 == 0 and "text_hash" not in stay[0].asDict()


def test_near_plan_follows_the_similarity():
    assert plan(85) == type(plan(85))(12, 3, 40) and plan(80) == type(plan(80))(16, 3, 36)
    for percent in range(17, 101):
        by = plan(percent)
        assert (1 - (percent / 100) ** by.depth) ** by.trees <= 1.1e-5 and by.trees * by.depth <= 64
    with pytest.raises(ValueError):
        plan(10)


def test_near_duplicates_edges(spark, documents):
    assert near_duplicates(documents([])).count() == 0
    found = near_duplicates(documents([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in found) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# decontamination

def test_decontamination_equals_the_plain_one(spark, documents):
    r = random.Random(4)
    items = [(i, sentence(r, n)) for i, n in enumerate([13, 20, 40, 5, 1, 13])] + [(6, None), (7, " .,"), (8, items_text := sentence(r, 30)), (9, items_text)]
    rows = [(100 + i, f"{sentence(r, 60)} {items[i % 10][1] or ''}! {sentence(r, 200)}") for i in range(20)]
    rows += [(200, items[2][1].upper().replace(" ", " -- ")), (201, " ".join(items[1][1].split()[:12])), (202, items[8][1] + " " + sentence(r, 700)), *[e for e in EDGES if e[0]]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (8 << 20, 200, 20):
        found = decontaminate(documents(rows).withColumn("out", F.lit(1)), bench, block_bytes=block, into="out").collect()
        expected = brute.decontaminate(rows, items)
        assert {x.doc_id: (x.out.n_words, x.out.n_hit, x.out.items_sha256, x.out.contaminated) for x in found} == {k: (a, b, brute.sha(c), d) for k, (a, b, c, d) in expected.items()}
    clean = [x for x in found if x.out.n_hit == 0]
    assert clean and all(x.out.kept == (x.text or "") for x in clean)
    (cut,) = [x for x in found if x.doc_id == 202]
    assert items[8][1] not in cut.out.kept
    assert not any(x.out.n_hit for x in decontaminate(documents(rows), bench.limit(0), into="out").collect())


# packing

def test_packing_round_trip(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    r = random.Random(8)
    rows = [(i, sentence(r, r.choice([0, 3, 50, 900]))) for i in range(60)] + [e for e in EDGES if e[0]] + [(50, "<|endoftext|> it's a\x1cb İ é 42 ### x<turn>"), (51, "Straße. ÉTÉ!! 'twas")]
    pieces = pack(documents(rows).repartition(5), tokenizer_path(), 256).collect()
    held, places = {}, set()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert len(p.ids) == 4 * p.size and p.offset + p.size <= 256
        where = range(p.sequence_id * 256 + p.offset, p.sequence_id * 256 + p.offset + p.size)
        assert places.isdisjoint(where)
        places |= set(where)
        held.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, list(np.frombuffer(p.ids, "<u4"))))
    assert places == set(range(len(places)))
    whole = {}
    for (doc, n), parts in held.items():
        tokens = [t for _, ids in sorted(parts, key=lambda x: x[0]) for t in ids]
        whole.setdefault(doc, []).extend(tokens)
    for doc, text in {d: t for d, t in rows}.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        copies = [t or "" for d, t in rows if d == doc]
        if len(copies) == 1:
            assert whole[doc] == ids
        else:
            assert len(whole[doc]) == sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in copies)
    assert pack(documents([]), tokenizer_path()).count() == 0


# language and quality

def test_language_by_held_out_texts(spark):
    r = random.Random(1)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "λμνξο"}
    make = lambda lang: " ".join("".join(r.choice(alphabets[lang]) for _ in range(r.randrange(2, 7))) for _ in range(30))
    known = [(make(lang), lang) for lang in alphabets for _ in range(20)] + [("abc", None), (None, "aa")]
    prototypes = language_id.learn(spark.createDataFrame(known, "text string, lang string"))
    assert list(prototypes) == ["aa", "bb", "cc"]
    asked = [(make(lang), lang) for lang in alphabets for _ in range(10)] + [(None, "und"), ("", "und"), ("12 34 !?", "und"), ("Λ" * 100_000, "cc")]
    found = language_id.predict(spark.createDataFrame(asked, "text string, score string").withColumn("language", F.lit(1)), prototypes).collect()
    assert [x.language.lang_pred for x in found] == [lang for _, lang in asked]
    assert all(0 <= x.language.score <= 1 for x in found)
    assert {x.language.lang_pred for x in language_id.predict(spark.createDataFrame(asked, "text string, lang string"), {}).collect()} == {"und"}


def plain_language_sums(text):
    """The bundled vector of a text, trigram by trigram."""
    known, total, lower = language_id._Letters(), np.zeros(language_id.DIMENSIONS), f" {text.lower()} "
    letter = lambda c: ord(c) if c.isalpha() else 0
    for i in range(1, len(lower) - 1):
        if letter(lower[i]):
            a, b, c = (known[letter(lower[i + k])].astype(float) for k in (-1, 0, 1))
            total += np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_language_vectors_equal_plain_ones(monkeypatch):
    """Whole texts and texts cut into stretches of few characters, with more trigrams than are held at once."""
    r = random.Random(5)
    texts = ["".join(r.choice("abcdefghij klm日本語 é1.") for _ in range(400)), "", "X", "12", "ab" * 50, sentence(r, 60)]
    expected = np.array([plain_language_sums(t) for t in texts])
    for characters, trigrams in ((1 << 20, 8192), (50, 16), (1, 4)):
        monkeypatch.setattr(language_id, "CHARACTERS", characters)
        monkeypatch.setattr(language_id, "TRIGRAMS", trigrams)
        found, counts = language_id.bundled(texts, np.arange(len(texts)), len(texts), language_id._Letters())
        assert np.allclose(found, expected)
        assert counts.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_language_of_many_letters_needs_little_memory():
    import tracemalloc

    r = random.Random(6)
    text = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(400_000))
    tracemalloc.start()
    language_id.bundled([text], np.zeros(1, np.int64), 1, language_id._Letters())
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_language_edges(spark):
    rows = [("abc", "aa"), ("abc", "aa"), (None, "aa")]
    prototypes = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert language_id.predict(spark.createDataFrame([], "text string"), prototypes).count() == 0
    assert language_id.learn(spark.createDataFrame([], "text string, lang string")) == {}
    assert {x.language.lang_pred for x in language_id.predict(spark.createDataFrame([("abc",), ("abc",)], "text string"), prototypes).collect()} == {"aa"}


def test_quality_features_hold_n_grams_of_two_to_four_letters():
    found = quality.features("abcd")
    grams = [g for n in (2, 3, 4) for g in ("<abcd>"[i : i + n] for i in range(7 - n))]
    assert found == [quality.bucket("<abcd>", 0), *(quality.bucket(g, len(g)) for g in grams)]
    same = quality.pair_buckets(np.array([5, 5, 7, 7, 5], np.uint64))
    assert same[0] == same[2] == 0 and 0 < same[1] < quality.BUCKETS and same[1] != same[3]


def test_quality_scores_equal_plain_sums(spark, documents):
    """The score of a text is the mean weight of its features, one by one."""
    r = random.Random(7)
    texts = [sentence(r, 20), "the the the the", "word", "", None, "Ünï 日本語 " * 5, " ".join([sentence(r, 3000), sentence(r, 9)])]
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS), 0.3)
    found = {x.doc_id: x.quality_score for x in quality.score(documents(list(enumerate(texts))).withColumn("quality_score", F.lit("mine")), model).collect()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        used = [f for w in words for f in quality.features(w)] + quality.pair_buckets(np.array([quality.word_hash(w) for w in words], np.uint64)).tolist()
        logit = 0.3 + (sum(model.weights[f] for f in used) / len(used) if used else 0)
        assert abs(found[i] - 1 / (1 + np.exp(-logit))) < 1e-12


@pytest.mark.parametrize("most, width", [(1, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4)])
def test_quality_sample_is_as_narrow_as_its_counts(most, width):
    """Three bytes a feature travel to the driver where a text repeats nothing very often, and come back as they were."""
    times = np.array([1, most, 1])
    counts = quality.packed_counts(times)
    assert len(counts) == 3 * width
    present, back = quality.unpacked(np.array([0, 7, 65_535], "<u2").tobytes(), counts)
    assert present.tolist() == [0, 7, 65_535] and back.tolist() == times.tolist() and back.itemsize == width


def test_quality_sample_comes_to_the_driver_in_parts(spark, documents, monkeypatch):
    """A sorted partition at a time, not all rows out of one task; the smallest hashes of ids still come first."""
    r, plans = random.Random(8), []
    rows = [(i, sentence(r, 12)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, label int")
    fetch, samples = type(labels).toLocalIterator, []
    monkeypatch.setattr(type(labels), "toLocalIterator", lambda self, *a, **k: (plans.append(self._jdf.queryExecution().optimizedPlan().toString()), fetch(self, *a, **k))[1])
    monkeypatch.setattr(quality, "fit", lambda sample, epochs: samples.append(sample))
    quality.train(documents(rows), labels, rows=30)
    assert len(plans) == 1 and "Limit" not in plans[0] and "Sort" in plans[0]
    first = [x.label for x in labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(30).collect()]
    assert [label for label, *_ in samples[0]] == first


def test_quality_model_does_not_depend_on_partitions(spark, documents):
    r = random.Random(4)
    rows = [(i, sentence(r, 12)) for i in range(80)] + [(3, "another text of one id")] * 5 + [(7, None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, 0)] * 3, "doc_id long, label int")
    models = [quality.train(documents(rows).repartition(n), labels.repartition(n), most_features=4000) for n in (1, 3, 7)]
    assert all((m.weights == models[0].weights).all() and m.bias == models[0].bias for m in models)


def test_quality_of_the_labelled_documents(spark):
    """Held-out labels of the given tables, as the query learns them: clean documents stay."""
    from barwright.llm import queries
    from barwright.llm.common import held_out

    scored = queries.op8_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(x.predicted == x.quality for x in rows) >= 0.95 * len(rows) > 50
    assert sum(x.quality == 1 and x.predicted == 0 for x in rows) <= 0.02 * len(rows)


def test_quality_by_held_out_texts(spark, documents):
    r = random.Random(6)
    junk = lambda: r.choice([lambda: re.sub(" ", "### ", sentence(r, 40)), lambda: sentence(r, 30).upper() + "!!", lambda: " ".join([r.choice(WORDS)] * 60)])()
    rows = [(i, sentence(r, 40) if i % 4 else junk()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(5, None), (None, 1), (6, 7)], "doc_id long, label int")
    model = quality.train(documents(rows), labels)
    found = quality.score(documents([*rows, (1000, None), (1001, " "), (1002, "ba" * 50_000)]), model).collect()
    held = [x for x in found if 300 <= x.doc_id < 400]
    assert sum((x.quality_score >= 0.7) == (x.doc_id % 4 > 0) for x in held) >= 95
    assert all(0 <= x.quality_score <= 1 for x in found)
    nothing = quality.train(documents(rows), labels.limit(0))
    assert {round(x.quality_score, 6) for x in quality.score(documents(rows), nothing).collect()} == {0.5}
    small = quality.train(documents(rows), labels, rows=10, most_features=500)
    assert np.isfinite(small.weights).all()


def test_packing_keeps_a_bounded_number_of_words():
    """Texts of ever new words, and odd ones: ids are the tokenizer's, and a worker never knows more pieces than it may."""
    import public_tokenizers

    from barwright.llm import packing

    encoder = packing._Encoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    assert encoder.by_piece and packing.PIECES <= 600_000
    encoder.known.most = 1000
    dice = random.Random(5)
    odd = ["", " ", "it's", "x-1", "ÉTÉ,", "a\xa0b", "ét", "– no", "<|x|>", "(one)", "\x1c", "Ω", "two...\n"]
    for _ in range(30):
        words = ["".join(dice.choice("abcdeéÜ") for _ in range(6)) + dice.choice(["", ",", "..."]) for _ in range(300)]
        rows = [" ".join([*words[i : i + 30], *dice.sample(odd, 3)]) for i in range(0, 300, 30)] + dice.sample(odd, 4)
        expected = [[*encoder.tokenizer.encode(row, add_special_tokens=False).ids, 1] for row in rows]
        assert [ids.tolist() for ids in encoder.many([row.encode() for row in rows])] == expected
        assert len(encoder.known.ends) <= 1001
