"""What the corpus operators share: checked broadcasts, row hashes, and batches of bounded size.

Operators that add a column replace one of the same name in their input; columns whose names begin with two underscores are their
own while they work, and input columns of such names may be replaced or dropped. All other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.sources.shared import new_path, shared_dir, stored

__all__ = ["BROADCAST_ROWS", "held_out", "new_path", "pieces", "shared_dir", "slices", "small_join", "stored", "texts", "tidy", "utf8"]

#: Rows of two or three longs that one broadcast may hold (about 50 MB); beyond it the operators join by shuffle.
BROADCAST_ROWS = 2_000_000


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is stored already: broadcast if it has at most `limit` rows, else by a shuffle that AQE splits."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)


def tidy(spark: SparkSession) -> None:
    """Have the driver's JVM collect what jobs that are done have left: plans, task metrics, generated classes. An operator of very many
    small jobs would else fill the driver with them before a collection is due."""
    spark._jvm.System.gc()


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4: rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts(column: pa.Array) -> Iterator[str]:
    """The strings of an Arrow column one by one, null as empty."""
    for value in column:
        yield value.as_py() or ""


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column one by one, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from utf8(chunk)
        return
    if pa.types.is_string(column.type):
        column = column.view(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def slices(iterator: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task derives from a batch stays small: at most `rows` rows, and `size` bytes if that is
    more than one row."""
    for batch in iterator:
        waiting = [batch.slice(start, rows) for start in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def pieces(text: pa.Array, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.Array]:
    """A column in stretches of at most `rows` values, and of `size` bytes if that is more than one value."""
    for part in slices(iter([pa.record_batch([text], names=["text"])]), rows, size):
        yield part.column(0)
