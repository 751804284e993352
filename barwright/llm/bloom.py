"""A pair of Bloom filters, for hashes seen once and seen at least twice, built on executors and merged by chunk.

A filter is a bit array of `bits` bits (a power of two); a key sets PROBES bits, derived from two 64-bit hashes.
A key put in twice, in one task or in two, has all its bits in the second filter: there are false repeats, no missed ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a key sets, and bits of a filter for each key that it is to hold.
PROBES, BITS_A_KEY = 4, 10
#: Bytes of a filter that are merged and shuffled as one row.
CHUNK = 1 << 17
#: Each filter has at most this many bits (256 MB), so its broadcast is bounded; a fuller filter only sends more suspects on.
MAX_BITS = 1 << 31


def bits_for(keys: int, most: int = MAX_BITS) -> int:
    """BITS_A_KEY for each key at least, as a power of two between one chunk and `most`."""
    return min(most, max(CHUNK * 8, 1 << int(np.ceil(np.log2(max(1, keys) * BITS_A_KEY)))))


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    step = h2 | np.uint64(1)
    return np.stack([(h1 + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])


def _has(field: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((field[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _put(field: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(field, at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


class Pair:
    """Both filters in one task."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """h1, h2: uint64 arrays; the same key may stand in them repeatedly."""
        if not len(h1):
            return
        _, first, count = np.unique(h1, return_index=True, return_counts=True)
        at = _positions(h1[first], h2[first], self.bits)
        again = (count > 1) | _has(self.once, at)
        _put(self.twice, at[:, again])
        _put(self.once, at)


def has(field: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which keys a merged filter holds."""
    return _has(field, _positions(h1, h2, len(field) * 8)) if len(h1) else np.zeros(0, bool)


SCHEMA = "chunk int, part int, once binary, twice binary"


def _rows(pair: Pair, part: int) -> pa.RecordBatch:
    size = min(CHUNK, len(pair.once))
    once, twice = pair.once.reshape(-1, size), pair.twice.reshape(-1, size)
    full = np.flatnonzero(once.any(axis=1))
    return pa.record_batch(
        {
            "chunk": pa.array(full, pa.int32()),
            "part": pa.array([part] * len(full), pa.int32()),
            "once": pa.array([zlib.compress(once[i], 1) for i in full], pa.binary()),
            "twice": pa.array([zlib.compress(twice[i], 1) for i in full], pa.binary()),
        }
    )


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    once = twice = None
    for a, b in zip(rows["once"], rows["twice"], strict=True):
        a, b = np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8)
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pd.DataFrame({"chunk": rows["chunk"].iloc[:1], "part": [0], "once": [zlib.compress(once, 1)], "twice": [zlib.compress(twice, 1)]})


def repeated(rows: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], bits: int) -> np.ndarray:
    """The twice-filter over the keys that `keys` finds in `rows`.

    Each task fills its own pair and sends the chunks that hold bits, compressed; chunks are merged in two levels, so that
    no task meets the chunks of more than about the root of the tasks. The result has bits / 8 bytes, whatever the input.
    """

    def build(batches):
        from pyspark import TaskContext

        pair = Pair(bits)
        for h1, h2 in keys(batches):
            pair.add(h1, h2)
        yield _rows(pair, TaskContext.get().partitionId() % 16)

    partial = rows.mapInArrow(build, SCHEMA).groupBy("chunk", "part").applyInPandas(_merge, SCHEMA)
    merged = partial.groupBy("chunk").applyInPandas(_merge, SCHEMA).select("chunk", "twice").collect()
    field = np.zeros(bits // 8, np.uint8)
    size = min(CHUNK, len(field))
    for row in merged:
        field[row.chunk * size : (row.chunk + 1) * size] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return field
