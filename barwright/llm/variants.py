"""Spelling variants: words one insertion, deletion or replacement apart, and the frequent form that each rare one stands for.

Words are counted over all texts. Two words at distance one keep one half unchanged, so words meet others by halves: a group is all
words of length m or m + 1 with the same first m // 2 (or last m - m // 2) code points. A group that holds too many words is split
by halves of what is left, again and again; as words differ, a group with one code point left is small by nature.
In a group, a bit-sliced index has for each (position, letter) the set of its words as one long integer, and a word is looked up by
word-parallel recurrences: the sets of words reached with no error, with one replaced, and with one inserted code point advance
together, one position at a time, over all words of the group at once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import slices, small_join, stored

#: Least code points and occurrences of a word, and how many times as frequent its form must be.
LENGTH, OCCURRENCES, TIMES = 6, 5, 5
#: One spelling in so many loses a code point.
SLIPS = 199
#: Letters of a run: fixed by the contract.
LETTERS = "A-Za-zÀ-ÿ"
#: Words that a group may hold before it is split, and distinct words that a task counts before it sends them on.
GROUP, HELD = 4096, 300_000
#: Rows of words that one broadcast may hold (some 20 MB); beyond it words meet by a shuffle.
WORDS = 200_000


def _spelt(run: str, start: int, slips: int) -> str:
    """The run, without one code point where its hash (the CRC of id and colon, carried on) is a multiple of `slips`."""
    h = zlib.crc32(run.encode(), start)
    if h % slips:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def word_counts(docs: DataFrame, least_length: int = LENGTH, least_n: int = OCCURRENCES, slips: int = SLIPS) -> DataFrame:
    """word, n of all words of at least `least_length` code points that occur at least `least_n` times in the texts.

    Words are maximal runs of letters, A-Z lower-cased, after the slips; null texts have none, a null doc_id counts as an empty
    one, and rows that repeat count each. Tasks add up before they send.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # a maximal run is matched whole, and slips never make one longer

    def count(batches):
        held: Counter = Counter()

        def sent():
            yield pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()

        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{doc_id}:".encode())
                # bytes.lower() touches A-Z alone.
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    word = _spelt(run, start, slips)
                    if len(word) >= least_length:
                        held[word] += n
            if len(held) >= HELD:
                yield from sent()
        if held:
            yield from sent()

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_n)


def _groups(words: DataFrame) -> DataFrame:
    """word, n, m, head, tail: each word as member of the group of all words of length m or m + 1."""
    bases = F.explode(F.array(F.length("word"), F.length("word") - 1))
    return words.select("word", "n", bases.alias("m"), F.lit(0).alias("head"), F.lit(0).alias("tail"))


def _halved(members: DataFrame) -> DataFrame:
    """Each row twice: with half of what its group leaves open fixed at its start, and with the other half fixed at its end."""
    open_ = F.col("m") - F.col("head") - F.col("tail")
    half = F.floor(open_ / 2).cast("int")
    ways = F.explode(F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")), F.struct(F.col("head").alias("head"), (F.col("tail") + open_ - half).alias("tail"))))
    return members.select("word", "n", "m", ways.alias("__way")).select("word", "n", "m", "__way.head", "__way.tail")


def _keyed(members: DataFrame) -> DataFrame:
    fixed = [F.expr("left(word, head)"), F.expr("right(word, tail)")]
    return members.withColumn("key", F.concat_ws(" ", F.col("m").cast("string"), F.col("head").cast("string"), F.col("tail").cast("string"), *fixed))


def _lookup(query: str, index: dict[tuple[int, str], int], alike: int, longer: int) -> int:
    """The members (a set of bits) one replacement away among `alike`, of the query's length, or one insertion among `longer`."""
    exact, replaced, inserted = alike | longer, 0, longer
    for i, letter in enumerate(query):
        here = index.get((i, letter), 0)
        after = exact & here
        replaced = replaced & here | exact & alike & ~here
        inserted = inserted & index.get((i + 1, letter), 0) | after & longer
        exact = after
        if not exact | replaced | inserted:
            return 0
    return replaced | inserted


def _pairs(words: list[str], ns: list[int], m: int, head: int, tail: int):
    """(place, place) of the words of one group at distance one, from the shorter one or either of two equally long ones."""
    open_ = [w[head : len(w) - tail] for w in words]
    index: dict[tuple[int, str], int] = {}
    alike = longer = 0
    for place, rest in enumerate(open_):
        bit = 1 << place
        if len(words[place]) == m:
            alike |= bit
        else:
            longer |= bit
        for i, letter in enumerate(rest):
            index[i, letter] = index.get((i, letter), 0) | bit
    for place, rest in enumerate(open_):
        if len(words[place]) == m:
            found = _lookup(rest, index, alike, longer)
            while found:
                low = found & -found
                yield place, low.bit_length() - 1
                found ^= low


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n, near, near_n: every two of the words (word, n; each word once) at distance one, in both directions, each once.

    Groups of more than `group` words are split until none is left or one code point is open, so a task holds few words at
    once, whatever letters the words share. An empty table gives no pairs.
    """
    ready, waiting = [], stored(_halved(_groups(words)), "halves")
    while True:
        keyed = _keyed(waiting)
        large = keyed.where(F.col("m") - F.col("head") - F.col("tail") > 1).groupBy("key").agg(F.count("*").alias("__n")).where(F.col("__n") > group)
        large = stored(large.select("key"), "large-groups")
        if not large.limit(1).count():
            ready.append(keyed)
            break
        ready.append(small_join(keyed, large, ["key"], "left_anti", WORDS))
        waiting = stored(_halved(small_join(keyed, large, ["key"], "left_semi", WORDS)), "halves")
    members = ready[0]
    for more in ready[1:]:
        members = members.unionByName(more)

    def meet(batches):
        held: tuple | None = None
        words, ns = [], []

        def found():
            out = [], [], [], []
            for a, b in _pairs(words, ns, *held[1:]):
                for x, y in ((a, b), (b, a)) if len(words[b]) > len(words[a]) else ((a, b),):
                    for column, value in zip(out, (words[x], ns[x], words[y], ns[y]), strict=True):
                        column.append(value)
            return out

        made: tuple = ([], [], [], [])
        send = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(made, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n", "near", "near_n"])
        for batch in batches:
            for key, word, n, m, head, tail in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "m", "head", "tail")), strict=True):
                if held is None or key != held[0]:
                    if len(words) > 1:
                        for column, values in zip(made, found(), strict=True):
                            column.extend(values)
                        if len(made[0]) > 20_000:
                            yield send()
                            made = ([], [], [], [])
                    held, words, ns = (key, m, head, tail), [], []
                words.append(word)
                ns.append(n)
        if len(words) > 1:
            for column, values in zip(made, found(), strict=True):
                column.extend(values)
        if made[0]:
            yield send()

    pairs = members.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "word string, n long, near string, near_n long")
    # A word with one code point more may share both halves; by word, so that what follows needs no other shuffle.
    return pairs.repartition("word").dropDuplicates(["word", "near"])


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms (word, form) that a word leads to, by joins that double the way each time.

    Forms must not run in circles; here each is several times as frequent as what it stands for, so ways are short.
    """
    ways = stored(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        if not ways.join(further, "root", "left_semi").limit(1).count():
            return ways
        ways = stored(small_join(ways, further, ["root"], "left", WORDS).select("word", F.coalesce("__next", "root").alias("root")), "ways")


def variants(docs: DataFrame, least_length: int = LENGTH, least_n: int = OCCURRENCES, times: int = TIMES, slips: int = SLIPS, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts (doc_id, text).

    n_near counts the words at distance one. form is the most frequent of them (ties: the smallest in code-point order), if it is
    at least `times` as frequent, else null; root is where the forms lead, the word itself if it has none. Without texts or
    frequent words the result is empty. Other columns of docs play no part.
    """
    words = stored(word_counts(docs, least_length, least_n, slips), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    nearest = near_words(words, group).groupBy("word").agg(F.max("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    led = -F.col("best.n") >= times * F.col("n")
    nearest = stored(nearest.select("word", "n_near", F.when(led, F.col("best.near")).alias("form"), F.when(led, -F.col("best.n")).alias("form_n")), "nearest")
    last = roots(nearest.where("form is not null"))
    found = small_join(small_join(words, nearest, ["word"], "left", WORDS), last, ["word"], "left", WORDS)
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
