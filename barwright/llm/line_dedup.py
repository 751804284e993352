"""Lines that several documents share, removed except in one of them.

Two Bloom filters mark line hashes seen once and seen twice; only lines in the second one are shuffled, to be counted exactly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import bloom
from barwright.llm.common import BROADCAST_ROWS, slices, stored, utf8

#: Fixed by the contract: the characters stripped from both ends of a line.
EDGE = b" \t\n\x0b\x0c\r"
#: Passes over the documents at most, each for one range of hashes.
RANGES = 16


def _key(line: bytes, least: int) -> bytes | None:
    key = line.strip(EDGE)
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key.lower()


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two uint64 arrays: the halves of each key's 128-bit hash."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _document_keys(batch: pa.RecordBatch, least: int):
    """For each document its distinct line hashes, as one pair of arrays and the documents' row numbers."""
    keys, owners = [], []
    for row, text in enumerate(utf8(batch.column("text"))):
        own = {k for line in text.split(b"\n") if len(line) >= least and (k := _key(line, least)) is not None}
        keys += own
        owners += [row] * len(own)
    return *_hashes(keys), np.asarray(owners, np.int64)


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, most_bits: int = bloom.MAX_BITS) -> DataFrame:
    """The lines to remove: h1, h2 (the halves of the key's 128-bit hash), keeper (the largest doc_id that holds it).

    A line's key is the line stripped of white space with A-Z in lower case; keys of at least `min_chars` code points found
    in at least `min_docs` distinct doc_ids count. Null texts hold no such line; a null doc_id counts as no document and is
    never the keeper. Rows that repeat a doc_id are one document. The table is stored.
    Where a filter of `most_bits` is too small for all lines, their hashes are split into ranges, each with a pass and filters of
    its own. Beyond RANGES passes the filters fill up: more lines are then suspects and are shuffled, and the result is the same.
    """
    docs = docs.select("doc_id", "text")
    size = F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    lines = docs.select(size).first()[0] or 0
    ranges = min(RANGES, max(1, -(-lines * bloom.BITS_A_KEY // most_bits)))
    return reduce(DataFrame.unionByName, [_repeated_in_range(docs, min_chars, min_docs, bloom.bits_for(-(-lines // ranges), most_bits), r, ranges) for r in range(ranges)])


def _repeated_in_range(docs: DataFrame, min_chars: int, min_docs: int, bits: int, number: int, ranges: int) -> DataFrame:
    """The repeated lines whose hashes lie in one of the ranges; stored, so that its filters are gone when the next range comes."""

    def keys(batches):
        for batch in slices(batches, 2048):
            h1, h2, owner = _document_keys(batch, min_chars)
            if ranges > 1:
                own = (h2 >> np.uint64(40)) % np.uint64(ranges) == number
                h1, h2, owner = h1[own], h2[own], owner[own]
            yield batch, h1, h2, owner

    field = bloom.repeated(docs, lambda batches: ((h1, h2) for _, h1, h2, _ in keys(batches)), bits)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def suspects(batches):
        for batch, h1, h2, owner in keys(batches):
            maybe = bloom.has(shared.value, h1, h2)
            ids = batch.column("doc_id").take(pa.array(owner[maybe]))
            yield pa.record_batch({"h1": pa.array(h1[maybe].view("<i8")), "h2": pa.array(h2[maybe].view("<i8")), "doc_id": ids})

    schema = f"h1 long, h2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    found = docs.mapInArrow(suspects, schema).groupBy("h1", "h2")
    exact = found.agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    out = stored(exact.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "lines")
    shared.destroy()
    return out


def _sieve(min_chars: int, known):
    """known: for a row's keys, the mask of those that go. Returns the function that cuts a column of texts."""

    def cut(text: pa.Array, doc_id: pa.Array, *more: pa.Array) -> pa.Array:
        n_lines, n_dropped, kept = [], [], []
        for row, whole in enumerate(utf8(text)):
            lines = whole.split(b"\n")
            keyed = [(i, k) for i, line in enumerate(lines) if len(line) >= min_chars and (k := _key(line, min_chars)) is not None]
            gone = 0
            if keyed:
                drop = known(*_hashes([k for _, k in keyed]), doc_id[row].as_py(), *(m[row] for m in more))
                gone = int(drop.sum())
                if gone:
                    out = {keyed[i][0] for i in np.flatnonzero(drop)}
                    whole = b"\n".join(line for i, line in enumerate(lines) if i not in out)
            n_lines.append(len(lines))
            n_dropped.append(gone)
            kept.append(whole)
        return pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["n_lines", "n_dropped", "kept"])

    return cut


RESULT = "n_lines long, n_dropped long, kept string"


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, into: str = "lines", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with a struct column `into`: n_lines, n_dropped, kept (the text without the lines that go).

    Lines are split at \\n; a null or empty text is one empty line. A document keeps all its other lines, in order. All
    columns of docs stay, but a column `into` is replaced; repeated rows are treated alike; an empty table gives an empty one.
    Up to `broadcast_rows` repeated lines are broadcast; beyond it each document gets its own list by two joins.
    """
    gone = repeated_lines(docs, min_chars, min_docs)
    if gone.limit(broadcast_rows + 1).count() <= broadcast_rows:
        table = gone.toArrow()
        h1, h2 = (np.asarray(table.column(c).to_numpy()) .view("<u8") for c in ("h1", "h2"))
        order = np.argsort(h1, kind="stable")
        shared = docs.sparkSession.sparkContext.broadcast((h1[order], h2[order], table.column("keeper").take(pa.array(order)).to_pylist()))

        def known(a, b, own):
            s1, s2, keeper = shared.value
            mask = np.zeros(len(a), bool)
            at = np.searchsorted(s1, a)
            for i in np.flatnonzero(s1[np.minimum(at, len(s1) - 1)] == a) if len(s1) else ():
                j = at[i]
                while j < len(s1) and s1[j] == a[i]:
                    if s2[j] == b[i]:
                        mask[i] = keeper[j] != own
                        break
                    j += 1
            return mask

        return docs.withColumn(into, F.arrow_udf(_sieve(min_chars, known), RESULT)(F.col("text"), F.col("doc_id")))
    return _dedup_by_join(docs, gone, min_chars, into)


def _dedup_by_join(docs: DataFrame, gone: DataFrame, min_chars: int, into: str) -> DataFrame:
    def holders(batches):
        for batch in slices(batches, 2048):
            h1, h2, owner = _document_keys(batch, min_chars)
            yield pa.record_batch({"h1": pa.array(h1.view("<i8")), "h2": pa.array(h2.view("<i8")), "__id": batch.column("doc_id").take(pa.array(owner))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", "text").mapInArrow(holders, f"h1 long, h2 long, __id {kind}").join(gone, ["h1", "h2"])
    lists = held.where(~F.col("__id").eqNullSafe(F.col("keeper"))).groupBy("__id").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone"))

    def known(a, b, own, listed):
        pairs = {(x["h1"], x["h2"]) for x in listed.as_py() or ()}
        return np.fromiter(((x, y) in pairs for x, y in zip(a.view("<i8").tolist(), b.view("<i8").tolist(), strict=True)), bool, len(a))

    joined = docs.join(lists, docs["doc_id"].eqNullSafe(lists["__id"]), "left")
    cut = F.arrow_udf(_sieve(min_chars, known), RESULT)(docs["text"], docs["doc_id"], F.col("__gone"))
    return joined.withColumn(into, cut).drop("__id", "__gone")
