import hashlib

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barwright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()[name](spark, SF)
    columns = sorted(found.columns)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    theirs = sorted((tuple(dict(zip(names, row))[c] for c in columns) for row in result.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == theirs


def test_pipeline_stages_keep_columns_and_clean_documents(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lines", F.lit("mine"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert docs.count() <= before.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "same text of a few plain words here", "en", "s", 30), (2, "same text of a few plain words here", "en", "s", 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_stage(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "None"]
    assert corpus_pipeline.line_stage(spark, docs, SF).count() == 4
    assert corpus_pipeline.benchmark_stage(spark, docs, SF).count() == 4
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_stage_takes_pairs_from_four_fifths_on(spark, documents):
    rows = []
    for i in range(40):
        words = [f"w{i}x{k}" for k in range(104)]
        # 100 sets of five words each: 90 of 110 shared (0.82), or 88 of 112 (0.79).
        changed = 10 if i % 2 else 12
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-changed], *(f"v{i}x{k}" for k in range(changed))]))]
    kept = {r.doc_id for r in corpus_pipeline.near_stage(spark, documents(rows), SF).collect()}
    assert kept == {2 * i for i in range(40)} | {2 * i + 1 for i in range(0, 40, 2)}


def test_near_duplicates_of_the_given_documents(spark):
    """The query on all documents of sf0.01, against all pairs."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute.near(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_near_dedup(spark, sf).collect()}
    assert {i: n for i, (n, _) in found.items()} == {i: n for i, (n, _) in expected.items()}
    assert sum(found[i] == expected[i] for i in expected) >= 0.999 * len(expected)


def test_personal_data_of_the_given_documents(spark):
    """The query's counts and base spans on all documents of sf0.001, against the plain patterns."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, SF).collect():
        spans = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")]


def test_languages_of_the_given_documents(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = [r for r in queries.op5_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out and docs[r.doc_id] is not None and r.lang_pred != "und"]
    assert len(rows) > 100 and sum(r.lang_pred == docs[r.doc_id] for r in rows) >= 0.98 * len(rows)


def test_held_out_rows_follow_crc32(spark):
    import zlib

    from barwright.llm.common import held_out

    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(queries.sha256(F.lit("")).alias("x")).first().x
