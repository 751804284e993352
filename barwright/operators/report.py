"""Tables about models and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_models(models: DataFrame) -> DataFrame:
    """Each symbol's model with the latest training time."""
    rest = [c for c in models.columns if c != "symbol"]
    return models.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.col("metadata.trained_at")).alias("m")).select("symbol", "m.*")


def model_details(models: DataFrame) -> DataFrame:
    m = "metadata"
    return latest_models(models).select("symbol", "k", f"{m}.trained_at", f"{m}.training_bars", f"{m}.log_likelihood", f"{m}.converged")


def transition_table(models: DataFrame) -> DataFrame:
    """symbol, from_label, to_label, probability: the matrix in long form."""
    rows = models.select("symbol", "regime_labels", F.posexplode("transition_matrix").alias("i", "row")).select("symbol", "regime_labels", "i", F.posexplode("row").alias("j", "probability"))
    label = lambda c: F.coalesce(F.try_element_at("regime_labels", F.col(c) + 1), F.concat(F.lit("state_"), F.col(c).cast("string")))
    return rows.select("symbol", label("i").alias("from_label"), label("j").alias("to_label"), "probability")


def request_counts(log: DataFrame) -> DataFrame:
    """symbol, requests, errors, mean_latency_ms of a log (symbol, is_error, latency_ms); works on a stream too."""
    return log.groupBy("symbol").agg(F.count("*").alias("requests"), F.count_if("is_error").alias("errors"), F.round(F.avg("latency_ms"), 3).alias("mean_latency_ms"))


def overview(instruments: DataFrame, models: DataFrame, log: DataFrame) -> DataFrame:
    """Every instrument with its model's labels, its requests, and whether it lacks a model."""
    known = latest_models(models).select("symbol", "regime_labels", F.col("metadata.trained_at").alias("trained_at"))
    joined = instruments.select("symbol").join(known, "symbol", "left").join(request_counts(log).select("symbol", "requests"), "symbol", "left")
    return joined.select("symbol", F.array_join("regime_labels", ",").alias("labels"), F.coalesce("requests", F.lit(0)).alias("requests"), F.col("trained_at").isNull().alias("missing_model"))


def status(models: DataFrame, log: DataFrame) -> DataFrame:
    """symbol, version, k, trained_at, training_bars, requests of each symbol's latest model."""
    return latest_status(models, request_counts(log))


def latest_status(models: DataFrame, counts: DataFrame) -> DataFrame:
    """status() from request_counts() that are there already."""
    rows = latest_models(models).select("symbol", F.col("schema_version").alias("version"), "k", "metadata.trained_at", "metadata.training_bars")
    return rows.join(counts.select("symbol", "requests"), "symbol", "left").fillna(0, ["requests"])
