"""The domain frames that the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import orderflow as O
from barwright.operators.features import features
from barwright.sources.schema import MODEL
from barwright.sources.shared import stored

#: A sample model with three states and six features: fixed values of the tests and queries.
SAMPLE_MODEL = {
    "schema_version": 2,
    "symbol": "NQ",
    "k": 3,
    "n_features": 6,
    "initial_probs": [0.4, 0.35, 0.25],
    "transition_matrix": [[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]],
    "means": [[0.0, -0.5, 0.0, 0.0, 0.8, 0.0], [0.1, 0.0, 0.1, 0.2, 1.0, 0.1], [0.0, 0.5, -0.1, 0.0, 1.5, 0.0]],
    "variances": [[0.5, 0.3, 0.2, 0.5, 0.3, 0.5], [1.0, 0.5, 0.3, 0.8, 0.5, 0.8], [2.0, 1.0, 0.5, 1.5, 1.0, 1.5]],
    "feature_mean": [0.0, 0.0, 0.0, 0.0, 1.0, 0.0],
    "feature_std": [1.0, 1.0, 0.5, 1.0, 0.5, 1.0],
    "regime_labels": ["low_vol", "trending", "high_vol"],
    "metadata": {"trained_at": "2024-03-01T00:00:00Z", "training_bars": 8000, "log_likelihood": -20000.0, "converged": True, "n_iterations": 40, "random_restarts": 3, "data_start": "2023-01-01", "data_end": "2023-12-31"},
}
#: A model of two states, and one whose states never change but by the filter's floor: values of this library's tests and queries.
TWO_STATES = SAMPLE_MODEL | {
    "k": 2,
    "initial_probs": [0.6, 0.4],
    "transition_matrix": [[0.9, 0.1], [0.2, 0.8]],
    "means": [[0.0, -0.4, 0.0, 0.0, 0.8, 0.0], [0.0, 0.6, 0.0, 0.1, 1.3, 0.1]],
    "variances": [[0.6, 0.4, 0.3, 0.6, 0.3, 0.6], [1.5, 0.9, 0.6, 1.2, 0.9, 1.2]],
    "regime_labels": ["low_vol", "high_vol"],
}
LASTING = SAMPLE_MODEL | {"initial_probs": [1.0, 0.0, 0.0], "transition_matrix": [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]}
#: symbol, version, in force from (null: always), model: two series keep a model, two change it in mid-series, one reaches the floor.
VERSIONS = [
    ("click", "v1", None, SAMPLE_MODEL),
    ("error", "v1", None, TWO_STATES),
    ("purchase", "v1", None, SAMPLE_MODEL),
    ("purchase", "v2", "2024-01-16 00:00:00", TWO_STATES),
    ("signup", "v1", None, TWO_STATES),
    ("signup", "v2", "2024-01-12 06:00:00", SAMPLE_MODEL),
    ("view", "v1", None, LASTING),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as quotes and trades: every fourth a bid, every fourth an ask, the rest trades."""
    part = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(part == 0, "B").when(part == 1, "A").otherwise("L").alias("kind"),
        (F.lit(100) + F.col("value")).alias("price"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the ticks, stored: what reads them several times reads the table."""
    return stored(O.bars_from_ticks(ticks(spark, sf_dir)), "bars")


def featured(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return features(bars(spark, sf_dir), **options)


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_sides(O.with_quotes(ticks(spark, sf_dir)))


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.bar_flow(sided(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as closed trades in whole cents: returned items lose; a part's smallest discounts give 0."""
    cents = F.round(F.col("l_extendedprice") * F.col("l_discount")) / 100
    number = F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("account"), number.alias("trade_id"), F.col("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") == "R", -cents).otherwise(cents).alias("pnl"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as fills: an account is a customer, odd orders enter and even ones leave."""
    symbol = F.element_at(F.array(*(F.lit(s) for s in ("NQ", "ES", "CL"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("account"), symbol.alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 4 < 2, 1).otherwise(-1).alias("side"), F.lit(1).alias("qty"), (F.col("o_totalprice") / 100).alias("price"), (F.col("o_orderkey") % 2 == 1).alias("is_entry"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample model for every symbol of the bars."""
    sample = spark.createDataFrame([SAMPLE_MODEL], MODEL).drop("symbol")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct().crossJoin(F.broadcast(sample))


def versions(spark: SparkSession) -> DataFrame:
    """The models of VERSIONS, with when each comes into force."""
    rows = [model | {"symbol": symbol, "metadata": model["metadata"] | {"trained_at": version}, "valid_from": start} for symbol, version, start, model in VERSIONS]
    return spark.createDataFrame(rows, f"{MODEL}, valid_from string").withColumn("valid_from", F.col("valid_from").cast("timestamp"))
