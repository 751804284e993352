"""Document quality by supervised subword embeddings: hashed vectors of words, word pairs and character n-grams, averaged, then a softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample of labelled documents. As the softmax acts on a
mean of vectors, each feature's part of the logit is one number once training ends, and scoring adds numbers up.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import pieces, slices, stored

#: Rows of the embedding table, their width, and the lengths of character n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 16, 16, (2, 3, 4)
#: Bound of the training sample: this many documents, and this many features over all of them.
SAMPLE_ROWS, SAMPLE_FEATURES = 4_000, 8_000_000
EPOCHS, RATE = 8, 0.5
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def bucket(feature: str, kind: int) -> int:
    """The row of a word (kind 0) or of an n-gram of `kind` characters."""
    return zlib.crc32(feature.encode("utf-8", "replace"), kind) % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks for its beginning and end."""
    marked = f"<{word}>"
    return [bucket(marked, 0), *(bucket(marked[i : i + n], n) for n in GRAMS for i in range(len(marked) - n + 1))]


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the neighbouring words' pairs, from the words' hashes. A word twice is one and the same pair whatever the word."""
    first, second = hashes[:-1], hashes[1:]
    mixed = (first * _PAIR + second) * _PAIR
    return np.where(first == second, 0, mixed >> np.uint64(48)).astype(np.int64) % BUCKETS


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


class _Grams(dict):
    """n-gram -> its weight; there are far fewer n-grams than words."""

    def __init__(self, weights: list[float], size: int):
        self.weights, self.size = weights, size

    def __missing__(self, gram: str) -> float:
        if len(self) >= 200_000:
            self.clear()
        found = self[gram] = self.weights[bucket(gram, self.size)]
        return found


class _Words(dict):
    """Word -> the sum of its features' weights, their number, and the word's hash; two generations are kept."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.older = weights.tolist(), {}
        self.grams = [(n, _Grams(self.weights, n).__getitem__) for n in GRAMS]

    def __missing__(self, word: str) -> tuple[float, int, int]:
        found = self.older.get(word)
        if found is None:
            marked = f"<{word}>"
            end, total, count = len(marked) + 1, self.weights[bucket(marked, 0)], 1
            for n, weight in self.grams:
                total += sum(map(weight, [marked[i : i + n] for i in range(end - n)]))
                count += max(0, end - n)
            found = (total, count, word_hash(word))
        if len(self) >= 300_000:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, in integers of 1, 2 or 4 bytes, as narrow as the largest allows."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def unpacked(buckets: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts from bytes; the integers stay as narrow as they came."""
    present = np.frombuffer(buckets, "<u2")
    return present, np.frombuffer(counts, f"<u{len(counts) // len(present)}" if len(present) else "<u1")


def _counts(texts: DataFrame) -> DataFrame:
    """at (where the text stands in the sample's order), label, buckets (16-bit integers, as bytes), counts (packed) of each labelled text."""

    def count(batches):
        for batch in slices(batches, 256):
            buckets, counts = [], []
            for text in batch.column("text").to_pylist():
                split = (text or "").split()
                hashes = np.fromiter(map(word_hash, split), np.uint64, len(split))
                present, times = np.unique(np.concatenate([*(np.array(features(w), np.int64) for w in split), pair_buckets(hashes)]).astype(np.int64), return_counts=True)
                buckets.append(present.astype("<u2").tobytes())
                counts.append(packed_counts(times))
            yield pa.record_batch([batch.column("at"), batch.column("label"), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], names=["at", "label", "buckets", "counts"])

    kind = "struct<h: bigint, doc_id: " + texts.schema["at"].dataType["doc_id"].dataType.simpleString() + ", text: bigint>"
    return texts.mapInArrow(count, f"at {kind}, label int, buckets binary, counts binary")


@dataclass(frozen=True)
class Model:
    """The logit of label 1: `bias` plus the mean of `weights` over a text's features."""

    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_features: int = SAMPLE_FEATURES, epochs: int = EPOCHS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, label 0 or 1).

    The sample is the `rows` distinct labels with the smallest hashes of doc_id, or as many of their texts, in that order, as have
    `most_features` features in all: the driver holds no more, whatever the tables, in 3 bytes a feature (more where counts pass
    255), and gets them a sorted partition at a time. It does not depend on how the tables are partitioned or ordered. Null ids and other labels teach nothing, null texts are empty, rows that repeat id and text teach
    once; with no sample every score is 0.5, with one label scores lean to it.
    """
    known = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows), "sample")
    at = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", F.xxhash64("text").alias("text"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(at.alias("at"), "text", "label").dropDuplicates(["at", "label"])
    sample, total = [], 0
    # No limit in the plan: it would bring all rows to one task, and from there to the driver at once.
    for row in stored(_counts(texts), "features").orderBy("at", "label").toLocalIterator():
        total += len(row.buckets) // 2
        if total > most_features or len(sample) == rows:
            break
        sample.append((row.label, *unpacked(row.buckets, row.counts)))
    return fit(sample, epochs)


def fit(sample: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Stochastic gradient descent over (label, buckets, counts); the rate falls linearly to zero."""
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    top, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * max(1, len(sample)), 0
    for _ in range(epochs):
        for i in random.permutation(len(sample)):
            label, buckets, counts = sample[i]
            counts = counts.astype(np.float32)
            rate = RATE * (1 - step / steps)
            step += 1
            share = counts / counts.sum() if len(counts) else counts
            hidden = share @ table[buckets] if len(buckets) else np.zeros(WIDTH, np.float32)
            logits = top @ hidden + bias
            odds = np.exp(logits - logits.max())
            gap = odds / odds.sum()
            gap[label] -= 1
            back = gap @ top
            top -= rate * np.outer(gap, hidden)
            bias -= 0.1 * rate * gap
            if len(buckets):
                # Every feature of the text gets the gradient of the mean, as if it stood alone.
                table[buckets] -= np.outer(np.minimum(share * len(buckets), 4.0), rate * back).astype(np.float32)
    return Model((table @ (top[1] - top[0])).astype(np.float64), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: Model, into: str = "quality_score") -> DataFrame:
    """docs with a double column `into`: how likely label 1 is, from 0 to 1.

    Every word of the whole text counts; null, empty and blank texts get the score of the bias alone. All rows and columns of
    docs stay in their partitions; a column `into` of docs is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def rate(text: pa.Array) -> pa.Array:
        if not state:
            state["words"] = _Words(shared.value.weights)
        words, weights, means = state["words"], shared.value.weights, []
        for part in pieces(text, 512):
            for whole in part.to_pylist():
                split = (whole or "").split()
                if not split:
                    means.append(0.0)
                    continue
                sums, counts, hashes = zip(*map(words.__getitem__, split), strict=True)
                pairs = pair_buckets(np.array(hashes, np.uint64))
                means.append((sum(sums) + weights[pairs].sum()) / (sum(counts) + len(pairs)))
        logits = np.array(means, np.float64) + shared.value.bias
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))), pa.float64())

    return docs.withColumn(into, F.arrow_udf(rate, "double")(F.col("text")))
