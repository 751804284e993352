import random
import re
import zlib
from collections import Counter

import pytest

from barwright.llm import variants as v


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, slips=199):
    """Words and counts by the plain rule, run by run."""
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % slips == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def expected(words):
    out = {}
    around = {a: [b for b in words if near(a, b)] for a in words}
    form = {a: min(bs, key=lambda b: (-words[b], b)) for a, bs in around.items() if bs}
    form = {a: b for a, b in form.items() if words[b] >= 5 * words[a]}
    for a in words:
        root = a
        while root in form:
            root = form[root]
        out[a] = (form.get(a), root, words[a], len(around[a]), words[form[a]] if a in form else None)
    return out


def sample(dice, n, letters="abé", length=(6, 8)):
    return ["".join(dice.choice(letters) for _ in range(dice.randrange(*length))) for _ in range(n)]


@pytest.mark.parametrize("group", [v.GROUP, 8])
def test_variants_against_every_pair(spark, documents, group):
    """Few letters, so that words have many neighbours and, with small groups, groups split again and again."""
    dice = random.Random(5)
    spelt = [(w, int(5 * 6 ** dice.random() ** 2)) for w in sample(dice, 600)]
    spelt += [("kettle", 3000), ("ketle", 9), ("kettles", 300), ("kettless", 40), ("kettlesss", 6), ("short", 50), ("aaaaaaaa", 9), ("aaaaaaaaa", 60)]
    rows = [(i, " ".join(w if dice.random() < 0.7 else w.upper() for w, n in spelt for _ in range(n // 4 + (i < n % 4)))) for i in range(4)]
    rows += [(None, "Étude étude ÉTUDE " * 9), (7, None), (8, ""), (9, "1234 _ ×÷×÷×÷ " * 3), (9, "1234 _ ×÷×÷×÷ " * 3)]
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in v.variants(documents(rows), group=group).collect()}
    assert found == expected(counted(rows))
    assert sum(form is not None for form, *_ in found.values()) > 3 and max(n for *_, n, _ in found.values()) > 5


def test_slips_and_lower_case(spark, documents):
    """Every third spelling loses a code point, and only A-Z is lower-cased."""
    dice = random.Random(6)
    rows = [(i, " ".join(sample(dice, 60, "abÀ", (6, 8)) * 3)) for i in range(30)]
    assert {r.word: r.n for r in v.word_counts(documents(rows), slips=3).collect()} == counted(rows, 3)


def test_nothing_to_count(spark, documents):
    for rows in ([], [(1, None), (2, "")], [(1, "rare words only")]):
        assert v.variants(documents(rows)).count() == 0


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("a", "b")], "word string, form string")
    assert {r.word: r.root for r in v.roots(forms).collect()} == {**{f"w{i}": "w21" for i in range(21)}, "a": "b"}


def test_a_large_group_is_split(spark):
    """Words that share their first half all: each still meets the few that are near it."""
    words = [f"common{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    found = v.near_words(table, group=32)
    assert {(r.word, r.near) for r in found.collect()} == {(a, b) for a in words for b in words if near(a, b)}
