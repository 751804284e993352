import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.llm import chat, warc
from barwright.llm.top_k import top_k

# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(1)
    big = ["".join(r.choice("abc é\r\n") for _ in range(1500)) for _ in range(3)]
    rows = [(i, f"http://x/{i}", big[i % 3]) for i in range(30)] + [(40, None, None), (41, "u\r\nv%", ""), (42, "http://s", "small"), (43, "http://s", "small"), (44, "http://l", "y" * 300_000)]
    index, folder = warc.write_warc(pages(spark, rows).repartition(4), f"file://{tmp_path}/w")
    back = {x.page_id: x for x in warc.read_warc(index, folder).collect()}
    assert len(back) == len(rows)
    firsts = {27 + i for i in range(3)}
    for page, url, html in rows:
        payload, x = (html or "").encode(), back[page]
        assert (x.payload_bytes, x.payload_digest, x.url) == (len(payload), hashlib.sha1(payload).hexdigest(), url)
        revisit = page < 30 and page not in firsts
        assert x.record_type == ("revisit" if revisit else "response") and x.refers_to == (27 + page % 3 if revisit else None)
        assert bytes(x.payload) == (b"" if revisit else payload)
    chosen = warc.read_warc(index.where("page_id % 7 = 0"), folder).select("page_id").collect()
    assert sorted(x.page_id for x in chosen) == [0, 7, 14, 21, 28, 42]


def test_warc_edges(spark, tmp_path):
    index, folder = warc.write_warc(pages(spark, []), f"file://{tmp_path}/none")
    assert warc.read_warc(index, folder).count() == 0
    index, folder = warc.write_warc(pages(spark, [(1, "u", "z" * 2000), (1, "u", "z" * 2000), (None, "u", "z" * 2000)]), f"file://{tmp_path}/twice")
    assert sorted(str(x.record_type) for x in warc.read_warc(index, folder).collect()) == ["response"] * 3


def test_ranges_are_joined_over_small_gaps():
    found = list(warc.coalesced([(0, 10), (10, 5), (20, 5), (20 + warc.GAP + 6, 1), (10 * warc.READ, warc.READ), (11 * warc.READ, 5)]))
    assert [(a, b, len(c)) for a, b, c in found] == [(0, 25, 3), (26 + warc.GAP, 27 + warc.GAP, 1), (10 * warc.READ, 11 * warc.READ, 1), (11 * warc.READ, 11 * warc.READ + 5, 1)]


# chat

TEXTS = ["", "plain", "\\### Assistant: </turn> ok", "### user <turn>\nno</turn>\n", "\\b \\l \\h \\\\", "é日\U0001f600\n\n", "<" * 50, "x" * 200_000, None]


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("part_bytes", [8 << 20, 64])
def test_chat_round_trip(spark, part_bytes):
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a<b>#\n", None]), r.choice(TEXTS)) for c in [*range(25), None] for t in range(r.randrange(1, 9))]
    rows += [(7, 1, "assistant", "tie"), (7, 1, "assistant", "tie")]
    parts = {}
    for x in chat.format_chat(turns(spark, rows).repartition(3), part_bytes=part_bytes).collect():
        parts.setdefault(x.conv_id, []).append(x)
    expected = {}
    for c, t, role, text in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[1], x[2] or "", (x[3] or "").encode())):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert parts.keys() == expected.keys()
    for c, own in parts.items():
        own.sort(key=lambda x: x.part)
        assert [x.part for x in own] == list(range(len(own))) and [x.last for x in own] == [False] * (len(own) - 1) + [True]
        assert [p for x in own for p in chat.parse(x.formatted)] == expected[c]
        learned = [chat.unescape(x.formatted[s.start : s.stop]) for x in own for s in x.loss]
        assert learned == [t for role, t in expected[c] if role == "assistant"]
    assert chat.format_chat(turns(spark, [])).count() == 0


def test_marks_never_occur_in_turns(spark):
    (row,) = chat.format_chat(turns(spark, [(1, i, "user", t) for i, t in enumerate(TEXTS[:-2])])).collect()
    assert row.formatted.count("</turn>\n") == row.formatted.count("### ") == len(TEXTS) - 2


# top-k


def brute_top_k(rows, queries, k):
    fine = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine[n] = (i, [int(np.floor(1024 * float(np.float32(x)))) for x in v])
    out = []
    for q in queries:
        own = next((v for i, v in fine.values() if i == q), None)
        if own is not None:
            scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in fine.values() if i != q and len(v) == len(own))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("dimensions", "scale"), [(64, 0.3), (5, 100.0), (40, 1e5)])
def test_top_k_equals_all_scores(spark, dimensions, scale):
    r = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in scale * r.standard_normal(dimensions)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [(400, None), (500, [None] * dimensions), (600, [float("nan")] * dimensions), (700, [float("inf")] * dimensions), (800, [1.0, 2.0]), (900, [0.5, 0.25]), (1000, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    asked = [i for i, _ in rows if i is not None and i % 100 == 0]
    for size in (32 << 20, 8 * dimensions * 2):
        found = top_k(df, df.where("vec_id % 100 = 0"), k=10, query_bytes=size).collect()
        assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found) == brute_top_k(rows, asked, 10)
    assert top_k(df.limit(0), df.limit(0)).count() == 0
    more = df.withColumns({"score": F.lit("x"), "rank": F.lit(1), "query_id": F.lit(2)})
    few = top_k(more.where("vec_id < 4"), df.where("vec_id = 0"), k=10).collect()
    assert len(few) == 3
