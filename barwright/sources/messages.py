"""Trades from text, models and requests as JSON, the model registry, and where new files are read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators.hmm import validated
from barwright.sources.bars import by_header, cells_of, cleaned, coerced, symbol_of
from barwright.sources.schema import MODEL, REQUEST, TICKS


def read_trades(spark: SparkSession, path: str, account: str = "default") -> tuple[DataFrame, DataFrame]:
    """(trades, rejected) of a text file with one P&L a line: blank lines and those that begin with # are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("trade_id"))
    lines = lines.where("line <> '' and line not like '#%'").withColumn("pnl", F.expr("try_cast(line AS DOUBLE)"))
    good = lines.where("pnl is not null").select(F.lit(account).alias("account"), "trade_id", F.lit(None).cast("timestamp").alias("ts"), "pnl")
    return good, lines.where("pnl is null").select("trade_id", "line")


def read_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sound models, refused ones with `error`) of JSON files, one model a file."""
    raw = spark.read.schema(f"{MODEL}, _corrupt_record string").option("multiLine", True).json(path)
    named = raw.withColumn("file", F.col("_metadata.file_path"))
    checked = validated(named).withColumn("error", F.when(F.col("_corrupt_record").isNotNull(), "not JSON").otherwise(F.col("error")))
    return checked.where("error is null").drop("_corrupt_record", "error"), checked.where("error is not null").select("file", "symbol", "error")


def write_models(models: DataFrame, registry: str, export: str | None = None) -> None:
    """Append to the Parquet registry by symbol; export also writes one JSON document a symbol."""
    models.write.mode("append").partitionBy("symbol").parquet(registry)
    if export:
        models.select("symbol", F.to_json(F.struct(*models.columns)).alias("value")).write.mode("overwrite").partitionBy("symbol").text(export)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The latest model of each symbol; read anew, it sees models that came since."""
    from barwright.operators.report import latest_models

    return latest_models(spark.read.schema(MODEL).parquet(path))


def parse_requests(messages: DataFrame, column: str = "value") -> DataFrame:
    """Request rows of a text column that holds an object or an array of objects; what is no JSON has type null."""
    text = F.trim(F.col(column))
    wrapped = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    fields = "struct<" + ", ".join(part.replace(" ", ": ", 1) for part in REQUEST.split(", ")) + ">"
    listed = F.coalesce(F.from_json(wrapped, f"array<{fields}>"), F.array(F.lit(None).cast(fields)))
    rows = messages.select(F.posexplode(listed).alias("seq", "r"))
    return rows.select("seq", "r.type", "r.symbol", F.to_timestamp("r.timestamp").alias("ts"), "r.features")


def encode(responses: DataFrame) -> DataFrame:
    """value: each row as a JSON message."""
    return responses.select(F.to_json(F.struct(*responses.columns)).alias("value"))


def ticks_of(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ticks, rejected) of rows with the columns of TICKS, batch or stream: a tick has a symbol, a time, a kind B, A or L, a
    positive price, and a volume of at least 0 (null as 0). seq breaks ties of ts; where it is null, rows of one ts are in no order."""
    named = raw.select(*(F.col(c).cast(t).alias(c) for c, t in (part.split(" ") for part in TICKS.split(", ")))).fillna({"volume": 0.0, "seq": 0})
    good = F.col("symbol").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin("B", "A", "L") & (F.col("price") > 0) & (F.col("volume") >= 0)
    good = F.coalesce(good, F.lit(False))
    return named.where(good), named.where(~good)


def read_ticks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ticks, rejected) of a folder of Parquet files with the columns of TICKS."""
    return ticks_of(spark.read.schema(TICKS).parquet(path))


def stream_ticks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """read_ticks() of the files that appear in a folder, as streams."""
    return ticks_of(spark.readStream.schema(TICKS).parquet(path))


def write_responses(responses: DataFrame, path: str, checkpoint: str):
    """Start writing a stream of response rows as JSON messages, one a line; it stops once what is present is written."""
    return encode(responses).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_exports(spark: SparkSession, folder: str, table: str, checkpoint: str):
    """Start taking in the CSV files that appear in `folder`, each once and by its own header; a file replaces its symbol's bars in `table`.

    Files whose name tells no symbol, and rows that do not parse, go to the folders `table`-quarantine and `table`-dropped; what
    the quality checks find in a symbol's new bars goes to `table`-warnings (symbol, check, n) and keeps nothing out. All of them
    are kept by batch, under its number, so a batch that is tried again replaces what it left. Returns the streaming query; it
    stops once all files present are taken in.
    """
    from barwright.operators.quality import quality

    raw = cells_of(spark.readStream.option("pathGlobFilter", "*.csv"), folder)

    def take(batch: DataFrame, number: int) -> None:
        cells = batch.persist()
        try:
            if not cells.limit(1).count():
                return
            rows = coerced(by_header(cells)).withColumn("symbol", symbol_of(F.col("__file")))
            rows.where("symbol is null").select("__file").distinct().write.mode("overwrite").parquet(f"{table}-quarantine/batch={number}")
            known = rows.where("symbol is not null")
            newest = known.groupBy("symbol").agg(F.max(F.struct("__time", "__file")).alias("__newest"))
            known = known.join(newest, "symbol").where(F.struct("__time", "__file") == F.col("__newest"))
            bars = known.select("symbol", "ts", "seq", "open", "high", "low", "close", "volume")
            bars.where("ts is null or open is null or high is null or low is null or close is null").write.mode("overwrite").parquet(f"{table}-dropped/batch={number}")
            good = cleaned(bars)
            good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(table)
            quality(good).write.mode("overwrite").parquet(f"{table}-warnings/batch={number}")
        finally:
            cells.unpersist()

    return raw.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
