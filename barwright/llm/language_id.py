"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram's vector is the product of its letters' vectors, each rotated by
its place; a text's vector is the sum of its trigrams' vectors, and a language's prototype the sum over its texts. A text takes
the language whose prototype is nearest by cosine.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import pieces, slices

DIMENSIONS = 1024
UNKNOWN = "und"
_SEED = 7919
#: Characters that are looked at together, and different trigrams whose vectors are held at once (32 MB).
CHARACTERS, TRIGRAMS = 1 << 20, 8192


@cache
def _letter_table() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[[i for i in range(0x110000) if not chr(i).isalpha()]] = 0
    return table


class _Letters(dict):
    """Code point -> random vector; 0 stands for anything between words."""

    def __missing__(self, point: int) -> np.ndarray:
        vector = self[point] = np.random.default_rng((_SEED, point)).choice(np.array([-1, 1], np.int8), DIMENSIONS)
        return vector


def _trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the documents and numbers of their trigrams, and the letters (three columns) behind each number.

    A trigram is a letter with what stands on both sides of it, in lower case; what is no letter counts as a gap. A text may be
    given as (what stands before, text, what stands after).
    """
    parts = [(" ", t.lower(), " ") if isinstance(t, str) else (t[0].lower()[-1:] or " ", t[1].lower(), t[2].lower()[:1] or " ") for t in texts]
    points = np.frombuffer("".join(x for part in parts for x in part).encode("utf-32-le", "replace"), np.uint32)
    points = _letter_table()[points]
    sizes = np.array([len(p[1]) + 2 for p in parts], np.int64)
    owner, inner = np.repeat(np.arange(len(texts)), sizes), np.ones(len(points), bool)
    ends = np.cumsum(sizes)
    inner[ends - 1] = inner[ends - sizes] = False
    middle = np.flatnonzero((points > 0) & inner)
    if not len(middle):
        return owner[middle], np.zeros(0, np.int64), np.zeros((0, 3), np.uint32)
    kinds, compact = _compact(points)
    n = np.int64(len(kinds))
    code = (compact[middle - 1] * n + compact[middle]) * n + compact[middle + 1]
    if n**3 <= 1 << 22:
        present = np.flatnonzero(np.bincount(code, minlength=1))
        number = np.zeros(int(n**3) + 1, np.int64)
        number[present] = np.arange(len(present))
        number = number[code]
    else:
        present, number = np.unique(code, return_inverse=True)
    letters = np.stack((kinds[present // n // n], kinds[present // n % n], kinds[present % n]), axis=1)
    return owner[middle], number, letters


def _compact(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = np.flatnonzero(np.bincount(points))
    number = np.zeros(int(kinds[-1]) + 1, np.int64)
    number[kinds] = np.arange(len(kinds))
    return kinds, number[points]


def _bound(letters: np.ndarray, known: _Letters) -> np.ndarray:
    """The trigrams' vectors, one row each."""
    if not len(letters):
        return np.zeros((0, DIMENSIONS), np.float32)
    kinds, place = np.unique(letters, return_inverse=True)
    place = place.reshape(letters.shape)
    single = np.stack([known[int(p)] for p in kinds])
    out = np.roll(single, 2, axis=1)[place[:, 0]]
    out *= np.roll(single, 1, axis=1)[place[:, 1]]
    out *= single[place[:, 2]]
    return out.astype(np.float32)


def _sums(groups: np.ndarray, number: np.ndarray, letters: np.ndarray, known: _Letters, n: int) -> np.ndarray:
    """The sum of the trigrams' vectors in each of n groups, some thousand different trigrams at a time."""
    out = np.zeros((n, DIMENSIONS))
    if len(letters) > TRIGRAMS:
        order = np.argsort(number, kind="stable")
        groups, number = groups[order], number[order]
    edges = np.searchsorted(number, np.arange(0, len(letters) + TRIGRAMS, TRIGRAMS)) if len(letters) > TRIGRAMS else [0, len(number)]
    for i, start in enumerate(range(0, len(letters), TRIGRAMS)):
        vectors = _bound(letters[start : start + TRIGRAMS], known)
        own, width = slice(edges[i], edges[i + 1]), len(vectors)
        counts = np.bincount(groups[own] * width + number[own] - start, minlength=n * width).reshape(n, width)
        out += counts.astype(np.float32) @ vectors
    return out


def _stretches(texts: list[str]):
    """(first text, texts) of some million characters at most; a longer text is cut, each cut with the letter on both sides of it."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        if held and size + len(text) > CHARACTERS:
            yield first, held
            held, size = [], 0
        if not held:
            first = i
        if len(text) <= CHARACTERS:
            held.append(text)
            size += len(text)
            continue
        for start in range(0, len(text), CHARACTERS):
            yield i, [(text[max(0, start - 1) : start], text[start : start + CHARACTERS], text[start + CHARACTERS : start + CHARACTERS + 1])]
    if held:
        yield first, held


def bundled(texts: list[str], groups: np.ndarray, n: int, known: _Letters) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the texts' trigram vectors in each of n groups, and how many trigrams each group has; groups[i] is text i's."""
    total, counts = np.zeros((n, DIMENSIONS)), np.zeros(n, np.int64)
    for first, part in _stretches(texts):
        owner, number, letters = _trigrams(part)
        own = groups[first + owner]
        present, own = np.unique(own, return_inverse=True)
        total[present] += _sums(own, number, letters, known, len(present))
        counts[present] += np.bincount(own, minlength=len(present))
    return total, counts


def learn(labelled: DataFrame) -> dict[str, list[float]]:
    """Prototypes from rows (text, lang): lang -> its bundled vector. Rows whose lang or text is null teach nothing.

    Every row counts. Tasks send one vector a language; the sum goes on by (lang, dimension), so no language is hot. The
    driver receives DIMENSIONS numbers for each language that occurs.
    """

    def bundle(batches):
        known, total = _Letters(), {}
        for batch in slices(batches, 256):
            names, group = np.unique(np.array(batch.column("lang").to_pylist(), object), return_inverse=True)
            vectors, _ = bundled([t or "" for t in batch.column("text").to_pylist()], group, len(names), known)
            for name, vector in zip(names, vectors, strict=True):
                total[name] = total.get(name, 0) + vector
        if total:
            yield pa.record_batch({"lang": pa.array(list(total)), "v": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    sums = rows.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    out: dict[str, list[float]] = {}
    for row in sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).collect():
        out.setdefault(row.lang, [0.0] * DIMENSIONS)[row.i] = row.x
    return {k: out[k] for k in sorted(out)}


def predict(docs: DataFrame, prototypes: dict[str, list[float]], into: str = "language") -> DataFrame:
    """docs with a struct column `into`: lang_pred, score (the cosine, at least 0).

    Texts that are null or hold no letter are `und` with score 0, as is every text if there are no prototypes; a tie goes to
    the first language by name. All rows and columns of docs stay in their partitions; a column `into` is replaced.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float64).reshape(len(names), DIMENSIONS)
    unit = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).T
    known = _Letters()

    def guess(text: pa.Array) -> pa.Array:
        found, scores = [], []
        for part in pieces(text):
            listed = [t or "" for t in part.to_pylist()]
            vectors, counts = bundled(listed, np.arange(len(listed)), len(listed), known)
            empty = (counts == 0) | (not names)
            cosine = vectors @ unit / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9) if names else np.zeros((len(part), 1))
            best = cosine.argmax(axis=1)
            found += [UNKNOWN if e else names[b] for e, b in zip(empty, best, strict=True)]
            scores += np.where(empty, 0.0, np.clip(cosine.max(axis=1), 0.0, 1.0)).astype(float).tolist()
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn(into, F.arrow_udf(guess, "lang_pred string, score double")(F.col("text")))
