"""Tables in the folder that all executors share: where a plan's lineage is cut, and what was written there is released again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that one broadcast may hold (about 50 MB).
BROADCAST_ROWS = 2_000_000

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session (tests) gets a folder of its own; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; release() removes what was written there."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a table that is cheap to count: broadcast if it has at most `limit` rows, else by a shuffle that AQE splits."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return big.join(small, on, how)


def remove(spark: SparkSession, name: str) -> bool:
    """Delete a path, whatever file system it is on; false if there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Remove what this process has stored so far; call it once the results that read it are written. Returns how many paths went."""
    n = 0
    while _written:
        n += bool(remove(spark, _written.pop()))
    return n
