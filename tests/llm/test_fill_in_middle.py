import hashlib
import random

import pytest
from pyspark.sql import functions as F

from barwright.llm import fim


def plain_version(doc_id, text):
    """Form, lengths and output by plain slicing."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    lo, hi = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    pre, mid, suf = text[:lo], text[lo:hi], text[hi:]
    if h[3] % 100 < 20:
        return len(text), "spm", lo, hi - lo, f"<S>{suf}<P>{pre}<M>{mid}"
    return len(text), "psm", lo, hi - lo, f"<P>{pre}<S>{suf}<M>{mid}"


def test_texts_of_all_kinds(spark, documents):
    dice = random.Random(3)
    rows = [(i, "".join(dice.choice("ab <>PSM\né€😀") for _ in range(dice.randrange(60)))) for i in range(300)]
    rows += [(None, "no id"), (None, None), (301, ""), (302, None), (303, "a"), (303, "a"), (304, "<P>"), (305, "x<S>y" * 3), (306, "é😀" * 40_000), (307, "a<P"), (308, "S>")]
    docs = documents(rows).withColumn("fim", F.lit("mine"))
    made = fim.fill_in_middle(docs.repartition(3))
    assert made.columns == docs.columns
    found = made.withColumn("back", fim.restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(found) == len(rows)
    for r in found:
        n, form, pre, mid, output = plain_version(r.doc_id, r.text)
        assert (r.fim.n, r.fim.form, r.fim.prefix_chars, r.fim.middle_chars, r.fim.output) == (n, form, pre, mid, output)
        assert r.fim.output_sha256 == hashlib.sha256(output.encode()).hexdigest()
        assert r.back.text == (r.text or "") and r.back.sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert {r.fim.form for r in found} == {"plain", "psm", "spm"}


def test_empty_table_and_shares(spark, documents):
    assert fim.fill_in_middle(documents([])).count() == 0
    forms = fim.fill_in_middle(documents([(i, "some text") for i in range(200)]), plain=0, spm=100).select("fim.form").distinct().collect()
    assert [r.form for r in forms] == ["spm"]


def test_other_sentinels_and_broken_outputs(spark, documents):
    marks = ("[pre]", "[suf]", "[mid]")
    made = fim.fill_in_middle(documents([(i, "text with <P> inside") for i in range(20)]), plain=0, sentinels=marks)
    assert {r.text for r in made.select(fim.restore(F.col("fim.output"), F.col("fim.form"), marks).text.alias("text")).collect()} == {"text with <P> inside"}
    broken = documents([(1, "<P>no more")]).select(fim.restore(F.col("text"), F.lit("psm")).alias("r"))
    with pytest.raises(Exception, match="lacks <S>"):
        broken.collect()
