"""Order flow of a tick stream: ticks that wait in a table of their own, ticks that come too late in another.

A symbol's clock is the latest event time it has shown, less the allowed lateness. Ticks behind the clock are late: they go to the side
table as they are and change no bar. Others wait until the clock passes the end of their bar, and are then taken in the order of (ts, seq), so
bars are those of the batch on the same ticks, in whatever order files bring them.

Each micro-batch is joins, windows and sums over what waits and what is new, by symbol and day; no symbol is one task. What it leaves to
the next lies in two tables under the checkpoint: `clocks`, and `waiting` with the ticks not taken and the last bid and ask of those taken.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.operators import orderflow as O
from barwright.sources.shared import remove, small_join

_TICK = "symbol string, ts timestamp, seq long, kind string, price double, volume double"
_CLOCK = "symbol string, latest timestamp"


def _micros(text: str) -> int:
    return int(pd.Timedelta(text).value // 1000)


def advanced(clocks: DataFrame, ticks: DataFrame) -> DataFrame:
    """symbol, latest: the clocks once these ticks have come."""
    new = ticks.groupBy("symbol").agg(F.max("ts").alias("latest"))
    return clocks.unionByName(new).groupBy("symbol").agg(F.max("latest").alias("latest"))


def by_lateness(ticks: DataFrame, clocks: DataFrame, lateness: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) of new ticks, by the clocks before they came; a symbol's first ticks are all in time."""
    behind = F.unix_micros("ts") < F.unix_micros("latest") - _micros(lateness)
    rows = small_join(ticks, clocks, ["symbol"], "left").withColumn("__late", F.coalesce(behind, F.lit(False))).drop("latest")
    return rows.where("not __late").drop("__late"), rows.where("__late").drop("__late")


def by_edge(ticks: DataFrame, clocks: DataFrame, width: str, lateness: str) -> tuple[DataFrame, DataFrame]:
    """(ready, waiting): a tick is ready once its bar ends at or before its symbol's clock."""
    clock: Column = F.unix_micros("latest") - _micros(lateness)
    edge = clock - F.pmod(clock, F.lit(_micros(width)))
    rows = small_join(ticks, clocks, ["symbol"]).withColumn("__ready", F.unix_micros("ts") < edge).drop("latest")
    return rows.where("__ready").drop("__ready"), rows.where("not __ready").drop("__ready")


def last_quotes(ticks: DataFrame) -> DataFrame:
    """The last bid and the last ask of each symbol, as ticks."""
    quotes = ticks.where("kind in ('B', 'A') and price is not null")
    # Times alone are found by hashing; only the ticks of the last time are compared as structs, which Spark does by sorting.
    latest = quotes.groupBy("symbol", "kind").agg(F.max("ts").alias("ts"))
    last = F.max_by(F.struct(*ticks.columns), "seq").alias("q")
    return quotes.join(F.broadcast(latest), ["symbol", "kind", "ts"]).groupBy("symbol", "kind").agg(last).select("q.*")


def write_tick_flow(ticks: DataFrame, bars: str, late: str, checkpoint: str, width: str = "1 hour", lateness: str = "10 minutes"):
    """Start the stream of ticks (sources.messages.ticks_of) into two tables: finished bars with the columns of orderflow.bar_flow(), and
    late ticks as they came, for the next batch run, which repairs history.

    All tables are kept by batch under its number. A batch tried again replaces what it left, and starts from what the one before it left.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = lambda name, n: f"{checkpoint}/flow/{name}/batch={n}"
        left = lambda name, n, schema: spark.read.schema(schema).parquet(table(name, n)) if n >= 0 else spark.createDataFrame([], schema)
        new = batch.persist()
        try:
            before = left("clocks", number - 1, _CLOCK)
            advanced(before, new).coalesce(1).write.mode("overwrite").parquet(table("clocks", number))
            in_time, behind = by_lateness(new, before, lateness)
            behind.write.mode("overwrite").parquet(f"{late}/batch={number}")
            pending = left("waiting", number - 1, _TICK).unionByName(in_time)
            ready, waiting = by_edge(pending, left("clocks", number, _CLOCK), width, lateness)
            flow = O.bar_flow(O.with_sides(O.with_quotes(ready)), width)
            flow.coalesce(8).write.mode("overwrite").parquet(f"{bars}/batch={number}")
            waiting.unionByName(last_quotes(ready).coalesce(1)).write.mode("overwrite").parquet(table("waiting", number))
            # The batch before this one is kept: this one may be tried again.
            for name in ("clocks", "waiting"):
                remove(spark, table(name, number - 2))
        finally:
            new.unpersist()

    rows = ticks.select(*(F.col(c).cast(t).alias(c) for c, t in (part.split(" ") for part in _TICK.split(", "))))
    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
