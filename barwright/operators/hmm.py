"""Scoring with Gaussian hidden Markov models: emissions, forward filter, best paths, likelihoods, validation and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import scalar as S
from barwright.plans import scan
from barwright.sources.schema import SYMBOLS
from barwright.sources.shared import small_join, stored

#: Fixed by the model contract: the version, and below the required fields and error codes.
SCHEMA_VERSION = 2
#: Models (some kilobytes each) that one broadcast may hold; beyond it rows meet them by a shuffle.
MODELS = 20_000


def emissions(rows: DataFrame, model: dict) -> DataFrame:
    """rows (with `features`) with log_emission: the log density of each state's diagonal Gaussian, as generated code."""
    xs = [F.col("features")[i] for i in range(model["n_features"])]
    lit = lambda values: [F.lit(float(v)) for v in values]
    return rows.withColumn("log_emission", F.array(*(S.log_gaussian(xs, lit(m), lit(v)) for m, v in zip(model["means"], model["variances"], strict=True))))


def emissions_from(rows: DataFrame, models: DataFrame) -> DataFrame:
    """rows joined with each symbol's model (a small table), with log_emission for any number of states and features."""
    cell = lambda x, m, v: F.log(v) + (x - m) * (x - m) / v

    def state(mean: Column, variance: Column) -> Column:
        floor = F.transform(variance, lambda v: F.greatest(v, F.lit(S.VARIANCE_FLOOR)))
        pairs = F.zip_with(F.zip_with(F.col("features"), mean, lambda x, m: F.struct(x.alias("x"), m.alias("m"))), floor, lambda p, v: cell(p["x"], p["m"], v))
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
        return F.lit(-0.5) * (F.size(mean) * F.log(F.lit(6.283185307179586)) + total)

    joined = small_join(rows, models.select("symbol", "k", "means", "variances"), ["symbol"], limit=MODELS)
    return joined.withColumn("log_emission", F.zip_with("means", "variances", state)).drop("means", "variances")


def in_force(models: DataFrame) -> DataFrame:
    """symbol, model_version, valid_from, valid_to and parameters of each model: when it is the one to score with.

    With a column valid_from a version holds from then until the next one's (the last of equals by trained_at); without it the
    version trained last holds always. Null bounds are open.
    """
    version = F.col("metadata.trained_at")
    parameters = F.struct("initial_probs", "transition_matrix", "means", "variances").alias("parameters")
    if "valid_from" not in models.columns:
        latest = models.groupBy("symbol").agg(F.max_by(F.struct(version.alias("model_version"), parameters), version).alias("m"))
        none = F.lit(None).cast("timestamp")
        return latest.select("symbol", "m.model_version", none.alias("valid_from"), none.alias("valid_to"), "m.parameters")
    # One row a version: their number bounds this window.
    one = models.groupBy("symbol", "valid_from").agg(F.max_by(F.struct(version.alias("model_version"), parameters), version).alias("m"))
    later = F.lead("valid_from").over(Window.partitionBy("symbol").orderBy("valid_from"))
    return one.select("symbol", "m.model_version", "valid_from", later.alias("valid_to"), "m.parameters")


def _own_model(rows: DataFrame, models: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """rows under the model in force, numbered from 0 anew under each one (`__bar_no` keeps the number), with its parameters in the
    first row of each block; and whether no model's transitions let the filter's floor act."""
    versions = stored(in_force(models), "models-in-force")
    exact = not versions.where(F.exists(F.flatten("parameters.transition_matrix"), lambda p: p < scan.TINY)).limit(1).count()
    held = versions.select("symbol", "model_version", F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    inside = (F.col("__from").isNull() | (F.col("ts") >= F.col("__from"))) & (F.col("__to").isNull() | (F.col("ts") < F.col("__to")))
    scored = small_join(rows.drop("model_version"), held, ["symbol"]).where(inside).drop("__from", "__to")
    first = stored(scored.groupBy("symbol", "model_version").agg(F.min("bar_no").alias("__first")), "first-bars")
    scored = small_join(scored, first.join(versions.select("symbol", "model_version", "parameters"), ["symbol", "model_version"]), ["symbol", "model_version"], limit=MODELS)
    scored = scored.withColumns({"__bar_no": F.col("bar_no"), "bar_no": F.col("bar_no") - F.col("__first")})
    return scored.withColumn("__parameters", F.when(F.col("bar_no") % block == 0, F.col("parameters"))).drop("parameters", "__first"), exact


def filtered(rows: DataFrame, model: dict | DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """rows (symbol, bar_no, features) with state_probs, step_ll, state and confidence: the forward filter as a blocked scan.

    model is one model for all rows, or a table of models (schema.MODEL, and valid_from if versions follow one another): then
    each bar is scored by its symbol's version in force at ts, with that model's number of states; a new version starts anew from
    its initial probabilities, and model_version is added (another column of that name is replaced). Bars before their symbol's first version give no row (hmm.answered
    reports requests without a model). The first bar goes through the transition matrix too. Where the filter's floor can
    act, blocks are run again until all follow from one another, so the result is that of the plain recursion.
    """
    if isinstance(model, DataFrame):
        own, exact = _own_model(rows, model, block)
        found = scan.blocked(own, scan.forward(), ["symbol", "model_version"], block, parameters="__parameters", exact=exact)
        found = found.drop("bar_no").withColumnRenamed("__bar_no", "bar_no")
    else:
        found = scan.blocked(emissions(rows, model), scan.forward(model), ["symbol"], block).drop("log_emission")
    return found.withColumns({"state": S.argmax(F.col("state_probs")), "confidence": F.array_max("state_probs")})


def likelihood(scored: DataFrame, *by: str) -> DataFrame:
    """The log likelihood of each series."""
    by = by or ("symbol",)
    return scored.groupBy(*by).agg(F.sum("step_ll").alias("log_likelihood"), F.count("*").alias("n_bars"))


def viterbi(rows: DataFrame, model: dict | DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """rows with state: the most likely path, the first of equals, by a max-plus scan and a scan back along predecessors.

    With a table of models each stretch of bars under one version (see filtered) has a path of its own, and model_version is added.
    """
    if isinstance(model, DataFrame):
        own, _ = _own_model(rows, model, block)
        keys = ["symbol", "model_version"]
        found = scan.blocked(own, scan.max_plus(), keys, block, parameters="__parameters")
        found = scan.blocked(found, scan.trace(), keys, block, backward=True).drop("bar_no").withColumnRenamed("__bar_no", "bar_no")
    else:
        found = scan.blocked(scan.blocked(emissions(rows, model), scan.max_plus(model), ["symbol"], block), scan.trace(), ["symbol"], block, backward=True)
    return found.drop("log_emission", "came_from", "best_end")


def validation_error(symbols: list[str] = SYMBOLS) -> Column:
    """The first thing wrong with a model row, or null: fields, version, symbol, dimensions, probabilities."""
    k, n = F.col("k"), F.col("n_features")
    required = ["schema_version", "symbol", "k", "n_features", "initial_probs", "transition_matrix", "means", "variances", "feature_mean", "feature_std", "regime_labels", "metadata"]
    rows_of = lambda column, width: F.exists(column, lambda row: row.isNull() | (F.size(row) != width))
    outside = lambda vector: F.exists(vector, lambda p: p.isNull() | (p < 0) | (p > 1))
    near_one = lambda vector: F.abs(F.aggregate(vector, F.lit(0.0), lambda acc, p: acc + p) - 1) < 1e-3
    checks = [(F.col(c).isNull(), F.lit(f"missing field: {c}")) for c in required]
    checks += [
        (F.col("schema_version") != SCHEMA_VERSION, F.concat(F.lit("schema version "), F.col("schema_version").cast("string"))),
        (~F.col("symbol").isin(symbols), F.concat(F.lit("unknown symbol: "), F.col("symbol"))),
        (~k.between(2, 10), F.lit("k is out of range")),
        (F.size("initial_probs") != k, F.lit("initial_probs has the wrong length")),
        ((F.size("transition_matrix") != k) | rows_of("transition_matrix", k), F.lit("transition_matrix has the wrong shape")),
        ((F.size("means") != k) | rows_of("means", n), F.lit("means has the wrong shape")),
        ((F.size("variances") != k) | rows_of("variances", n), F.lit("variances has the wrong shape")),
        (F.size("feature_mean") != n, F.lit("feature_mean has the wrong length")),
        (F.size("feature_std") != n, F.lit("feature_std has the wrong length")),
        (outside("initial_probs") | F.exists("transition_matrix", outside), F.lit("a probability is out of range")),
        (~F.forall("transition_matrix", near_one), F.lit("a transition row does not sum to 1")),
    ]
    return F.coalesce(*(F.when(bad, message) for bad, message in checks))


def validated(models: DataFrame) -> DataFrame:
    """models with `error`, null where the model is sound."""
    return models.withColumn("error", validation_error())


def answered(requests: DataFrame, models: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that can be scored, joined with their model's row, and error rows (symbol, code, message) for the others.

    The model table is broadcast behind a count; a request of unknown type, without a model, or with the wrong number of features is
    an error.
    """
    joined = small_join(requests, models.select("symbol", "k", "n_features", F.col("metadata.trained_at").alias("model_version")), ["symbol"], "left", MODELS)
    code = F.coalesce(
        F.when(F.coalesce(F.col("type"), F.lit("")) != "infer", F.lit("INVALID_REQUEST")),
        F.when(F.col("k").isNull(), F.lit("MODEL_NOT_FOUND")),
        F.when(F.coalesce(F.size("features"), F.lit(-1)) != F.col("n_features"), F.lit("INVALID_FEATURES")),
    )
    coded = joined.withColumn("code", code)
    message = F.concat_ws(" ", "code", F.lit("for"), F.coalesce("symbol", F.lit("?")))
    errors = coded.where("code is not null").select(F.lit("error").alias("type"), "symbol", "code", message.alias("message"))
    return coded.where("code is null").drop("code"), errors


def response(scored: DataFrame) -> DataFrame:
    """Scored rows as response messages: probabilities to six places, and the model's version where the rows tell it."""
    version = ["model_version"] if "model_version" in scored.columns else []
    return scored.select(F.lit("result").alias("type"), "symbol", "ts", *version, S.rounded(F.col("state_probs")).alias("state_probs"), "state", F.round("confidence", 6).alias("confidence"))
