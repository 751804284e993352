"""Benchmark passages in training documents: found by a broadcast table of n-gram hashes, verified word by word, then removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import stored, utf8

#: A byte is part of a word if it is a digit, a letter, or part of a code point above 7F; the rest become spaces.
WORD_BYTES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of benchmark text in a block (its tables take some six times as much), and blocks that a worker holds at once.
BLOCK_BYTES, TOGETHER = 8 << 20, 8
EARLIER = "runs array<long>, items array<string>"
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, kept string"


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_BYTES).split()


def _windows(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of `size` ids."""
    n = len(ids) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * _BASE + ids[i : i + n]
    return total


class Windows:
    """A block of the benchmark: its vocabulary, its items' words as numbers, and for each window size sorted hashes of the windows.

    A window is kept as its place among the numbered words: 12 bytes, whatever its size; the words themselves stand there once.
    """

    def __init__(self, items: list, texts: Iterable[bytes], size: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items, ends, numbered = items, [], []
        number = self.vocabulary.setdefault
        for text in texts:
            numbered.append(np.array([number(w, len(self.vocabulary) + 1) for w in words(text)], np.uint32))
            ends.append(len(numbered[-1]))
        self.words = np.concatenate([*numbered, np.zeros(0, np.uint32)])
        self.ends = np.cumsum(ends)
        begins, widths = self.ends - ends, np.minimum(size, ends)
        self.tables = {}
        for width in np.unique(widths[widths > 0]).tolist():
            own = np.flatnonzero(widths == width)
            counts = np.array(ends)[own] - width + 1
            place = np.repeat(begins[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            hashes = np.zeros(len(place), np.uint64)
            for i in range(width):
                hashes = hashes * _BASE + self.words[place + i]
            order = np.argsort(hashes, kind="stable")
            self.tables[width] = (hashes[order], place[order].astype(np.uint32))

    def scan(self, text: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words lie in an occurrence of a window, and the items whose windows occur."""
        n, items = len(text), set()
        hit = np.zeros(n + 1, np.int64)
        ids = np.fromiter(map(self.vocabulary.get, text, repeat(0)), np.uint64, n)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for width, (hashes, places) in self.tables.items():
            if n < width:
                continue
            starts = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(starts):
                continue
            total = np.zeros(len(starts), np.uint64)
            for i in range(width):
                total = total * _BASE + ids[starts + i]
            first, last = np.searchsorted(hashes, total), np.searchsorted(hashes, total, "right")
            found = np.flatnonzero(last > first)
            if not len(found):
                continue
            # Every place of a hash, beside the window that met it; then word by word.
            counts = last[found] - first[found]
            place = places[np.repeat(first[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())].astype(np.int64)
            start = np.repeat(starts[found], counts)
            true = np.ones(len(place), bool)
            for i in range(width):
                true &= self.words[place + i] == ids[start + i]
            np.add.at(hit, start[true], 1)
            np.add.at(hit, start[true] + width, -1)
            items.update(self.items[i] for i in np.unique(np.searchsorted(self.ends, place[true], "right")).tolist())
        return np.cumsum(hit)[:n] > 0, items


def _without(text: bytes, hit: np.ndarray) -> bytes:
    """The text with every run of hit words, from its first byte to its last, cut out."""
    marks = np.frombuffer(text.lower().translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], marks.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, last = [], 0
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True):
        out.append(text[last : starts[a]])
        last = ends[b - 1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.05, into: str = "hits", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column `into`: n_words, n_hit, n_items, items_sha256, contaminated, kept (the text without hit passages).

    Words are what [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ finds after lower-casing A-Z; null texts have none. A benchmark item
    gives its runs of `window` words, or itself if shorter; items without words, or null, give nothing; equal items all count;
    a null item_id is named as the empty string. contaminated: at least one word is hit and n_hit >= share * n_words. All rows
    and columns of docs stay, but a column `into` is replaced. An empty benchmark hits nothing.

    The benchmark is read in blocks of about `block_bytes` of text, each broadcast on its own; TOGETHER blocks are scanned in one
    pass over the documents, and what a pass found is stored beside them before the next one. Nothing is shuffled.
    """
    session = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    if n_blocks > 1:
        items = stored(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)).cast("int")).repartition("block").sortWithinPartitions("block"), "benchmark")
    passes = [range(i, min(i + TOGETHER, n_blocks)) for i in range(0, n_blocks, TOGETHER)]
    for last, group in ((p is passes[-1], p) for p in passes):
        blocks = []
        for block in group:
            rows = (items.where(F.col("block") == block) if n_blocks > 1 else items).select("item", "text").toArrow()
            blocks.append(session.sparkContext.broadcast(Windows(rows.column("item").to_pylist(), utf8(rows.column("text")), window)))
        scan = _scan(blocks, share) if last else _partial_scan(blocks)
        earlier = F.col("__earlier") if "__earlier" in docs.columns else F.lit(None).cast("struct<runs: array<bigint>, items: array<string>>")
        docs = docs.withColumn(into if last else "__earlier", F.arrow_udf(scan, RESULT if last else EARLIER)(F.col("text"), earlier))
        if not last:
            docs = stored(docs, "scanned")
            for block in blocks:
                block.destroy()
    return docs.drop("__earlier")


def _found(whole: bytes, before: dict | None, blocks: list) -> tuple[list[bytes], np.ndarray, set]:
    """The words, which of them are hit, and the items, in these blocks and in the passes before."""
    found = words(whole)
    hit, names = np.zeros(len(found), bool), set(before["items"] if before else ())
    if before:
        for start, stop in zip(before["runs"][::2], before["runs"][1::2], strict=True):
            hit[start:stop] = True
    for block in blocks:
        more, own = block.value.scan(found)
        hit |= more
        names |= own
    return found, hit, names


def _partial_scan(blocks: list):
    def scan(text: pa.Array, earlier: pa.Array) -> pa.Array:
        runs, items = [], []
        for whole, before in zip(utf8(text), earlier, strict=True):
            _, hit, names = _found(whole, before.as_py(), blocks)
            runs.append(np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist())
            items.append(sorted(names))
        return pa.StructArray.from_arrays([pa.array(runs, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["runs", "items"])

    return scan


def _scan(blocks: list, share: float):
    def scan(text: pa.Array, earlier: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in range(6)]
        for whole, before in zip(utf8(text), earlier, strict=True):
            found, hit, names = _found(whole, before.as_py(), blocks)
            n_hit = int(hit.sum())
            row = (len(found), n_hit, len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), n_hit > 0 and n_hit >= share * len(found) - 1e-9, _without(whole, hit) if n_hit else whole)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        columns[-1] = columns[-1].cast(pa.string())
        return pa.StructArray.from_arrays(columns, names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "kept"])

    return scan
