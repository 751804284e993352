"""Streams without state of their own: order flow by watermark, request counts, scoring against the latest models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.operators.orderflow import bar_flow
from barwright.operators.report import latest_status, request_counts
from barwright.sources.shared import small_join


def flow_stream(sided: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """bar_flow() over a stream of sided trades; a bar is final once the watermark passes its end."""
    return bar_flow(sided.withWatermark("ts", late), width)


def status_stream(log: DataFrame) -> DataFrame:
    """Requests, errors and mean latency so far by symbol; write with outputMode('complete')."""
    return request_counts(log)


def write_status(log: DataFrame, registry, path: str, checkpoint: str):
    """Start a stream that keeps a table of every model's status at `path`: version, states, training and requests so far.

    registry: a function that reads the models anew for each micro-batch, so that models that came since are in it.
    """

    def take(counts: DataFrame, _: int) -> None:
        latest_status(registry(), counts).write.mode("overwrite").parquet(path)

    return status_stream(log).writeStream.outputMode("complete").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_latest_models(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests with `model`, the JSON of their symbol's latest model. Call it in foreachBatch on a registry read anew, or on a
    stream with a static registry."""
    models = registry.select("symbol", F.to_json(F.struct(*registry.columns)).alias("model"))
    return small_join(requests, models, ["symbol"], limit=20_000)
