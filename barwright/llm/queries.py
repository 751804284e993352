"""The registered queries of the corpus operators; each reads whole tables and returns its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import language_id, pii, quality
from barwright.llm.chat import format_chat, parse, unescape
from barwright.llm.common import held_out
from barwright.llm.decontamination import decontaminate
from barwright.llm.fim import fill_in_middle, restore
from barwright.llm.line_dedup import dedup_lines
from barwright.llm.near_dedup import near_duplicates
from barwright.llm.packing import pack
from barwright.llm.token_files import read_tokens, write_tokens
from barwright.llm.top_k import top_k
from barwright.llm.variants import variants
from barwright.llm.warc import read_warc, write_warc

#: Length of a packed sequence, and the id that ends each document.
SEQUENCE, END_ID = 2048, 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sha256(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *counts, sha256(pii.listed(base)).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = write_warc(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_dropped", sha256(F.col("lines.kept")).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE, END_ID)
    return pieces.select("doc_id", "start", F.col("size").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language_id.learn(docs.where(~held_out(F.col("doc_id"))))
    found = language_id.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "hits.n_words", "hits.n_hit", "hits.n_items", "hits.items_sha256", "hits.contaminated")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Learned from those of docs that have labels and are not held out."""
    labels = read(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    return quality.train(docs, labels)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir), "score")
    # The threshold of the contract; the score is computed once, below the projection.
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def _read_back(batches):
    """Digests of formatted conversations, part by part: only running hashes are kept between parts."""
    import hashlib

    import pyarrow as pa

    turns = loss = None
    n_turns = loss_chars = chars = 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if turns is None:
                turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            text = row["formatted"]
            for role, said in parse(text):
                turns.update(f"{role}\n{said}\n".encode())
                n_turns += 1
            for span in row["loss"]:
                said = unescape(text[span["start"] : span["stop"]])
                loss.update(said.encode())
                loss_chars += len(said)
            chars += len(text)
            if row["last"]:
                out.append({"conv_id": row["conv_id"], "n_turns": n_turns, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})
                turns = None
        kinds = [("conv_id", batch.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        yield from pa.Table.from_pylist(out, pa.schema(kinds)).to_batches()


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(more)
    return format_chat(turns).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    index, folder = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return read_tokens(index, folder, kind, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    # The text is rebuilt from nothing but output and form.
    docs = docs.select("doc_id", "fim").withColumn("back", restore(F.col("fim.output"), F.col("fim.form")))
    return docs.select("doc_id", *(f"fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256")), F.col("back.sha256").alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_warc, op3_line_dedup, op4_packing, op5_language_id, op6_decontamination, op7_near_dedup, op8_quality, op9_chat, op10_top_k, op11_token_files, op12_spelling_variants, op13_fill_in_middle)}


OP2_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM firsts
"""

OP3_SQL = """
WITH lines AS (
  SELECT doc_id, i, line
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\\n'), 1) AS i FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, E' \\t\\n\\x0b\\x0c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), gone AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.i, k.line, g.key IS NOT NULL AND g.keeper <> k.doc_id AS dropped FROM keyed k LEFT JOIN gone g ON k.key = g.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, E'\\n' ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), item_windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS width, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), widths AS (SELECT DISTINCT width FROM item_windows
), doc_windows AS (
  SELECT doc_id, i, width, array_to_string(w[i : i + width - 1], ' ') AS gram
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, widths WHERE len(w) >= width)
), found AS (
  SELECT doc_id, i, d.width, item_id FROM doc_windows d JOIN item_windows b ON d.width = b.width AND d.gram = b.gram
), hit AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit h ON w.doc_id = h.doc_id LEFT JOIN named n ON w.doc_id = n.doc_id
"""


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(20 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 6 GROUP BY doc_id, run
), raw AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM runs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM raw, crc
), spelt AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cuts AS (
  SELECT word, i, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT x.word, y.word AS near FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.a || c.b
), ranked AS (
  SELECT p.word, w.n, p.near, v.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near, row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS place
  FROM pairs p JOIN words w ON w.word = p.word JOIN words v ON v.word = p.near
), led AS (SELECT word, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM ranked WHERE place = 1
), way(word, tip, step) AS (
  SELECT word, form, 1 FROM led WHERE form IS NOT NULL
  UNION ALL SELECT y.word, l.form, step + 1 FROM way y JOIN led l ON l.word = y.tip WHERE l.form IS NOT NULL
), ends AS (SELECT word, arg_max(tip, step) AS root FROM way GROUP BY word)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words w LEFT JOIN led l ON l.word = w.word LEFT JOIN ends r ON r.word = w.word
"""

OP13_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM t
), f AS (
  SELECT doc_id, n, text, least(a, b) AS p, greatest(a, b) - least(a, b) AS m,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), s AS (SELECT *, substring(text, 1, p) AS pre, substring(text, p + 1, m) AS mid, substring(text, p + m + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_line_dedup": OP3_SQL, "op6_decontamination": OP6_SQL, "op9_chat": OP9_SQL, "op10_top_k": OP10_SQL, "op12_spelling_variants": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
