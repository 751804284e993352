"""How far recent scores and features have moved from what a model was trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import SMALL
from barwright.operators.features import BUCKET, by_halo
from barwright.sources.schema import FEATURES
from barwright.sources.shared import small_join, stored

#: Fixed limits: rows of the window, rows that make it ready, states and rows that the measures need.
WINDOW, READY, LEAST_STATES, LEAST_ROWS = 500, 100, 10, 30
#: Models that one broadcast may hold.
MODELS = 20_000
THRESHOLDS = {"occupancy": 0.3, "transition": 0.5, "likelihood": 0.2, "feature": 0.15}


def latest(scored: DataFrame, window: int = WINDOW) -> DataFrame:
    """The last `window` rows of each symbol, by (ts, seq)."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("seq"))
    return scored.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= window).drop("__n")


def evidence(recent: DataFrame, k: int) -> DataFrame:
    """One row a symbol with all that the measures need, in one aggregate: n, state counts `c`, counts of state changes `moves`
    (k times k, by rows), mean_ll, and means and deviations of the features."""
    order = Window.partitionBy("symbol").orderBy("ts", "seq")
    rows = recent.withColumn("__from", F.lag("state").over(order)) if "state" in recent.columns else recent.withColumns({"state": F.lit(None).cast("int"), "__from": F.lit(None).cast("int")})
    both = lambda i, j: F.count_if((F.col("__from") == i) & (F.col("state") == j))
    found = [f for f in FEATURES if f in recent.columns]
    return rows.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.array(*(F.count_if(F.col("state") == i) for i in range(k))).alias("c"),
        F.array(*(both(i, j) for i in range(k) for j in range(k))).alias("moves"),
        (F.avg("step_ll") if "step_ll" in recent.columns else F.lit(None).cast("double")).alias("mean_ll"),
        F.array(*(F.avg(f) for f in found)).alias("seen_mean"),
        F.array(*(F.stddev_samp(f) for f in found)).alias("seen_std"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _occupancy(k: int) -> Column:
    even = F.col("n") / k
    return _sum(F.transform("c", lambda c: (c - even) * (c - even) / even)) / k


def _transitions() -> Column:
    """From `moves` and the model's matrix: the sum of p ln(p / q) over all cells, both bounded to [1e-10, 1], by k."""
    bounded = lambda x: F.least(F.greatest(x, F.lit(SMALL)), F.lit(1.0))

    def row(q: Column, i: Column) -> Column:
        own = F.slice("moves", i * F.size(q) + 1, F.size(q))
        total = _sum(F.transform(own, lambda c: c.cast("double")))
        return _sum(F.zip_with(own, q, lambda c, q: (lambda p: p * F.log(p / bounded(q)))(bounded(F.when(total > 0, c / total).otherwise(0.0)))))

    divergence = _sum(F.transform("transition_matrix", row)) / F.size("transition_matrix")
    return F.when(F.col("n") < LEAST_STATES, 0.0).otherwise(F.greatest(divergence, F.lit(0.0)))


def _likelihood(baseline: str) -> Column:
    trained = F.col("metadata.log_likelihood")
    if baseline == "per_bar":
        trained = trained / F.greatest(F.col("metadata.training_bars"), F.lit(1))
    drop = (trained - F.col("mean_ll")) / F.greatest(F.lit(1.0), F.abs(trained))
    return F.when(trained == 0, 0.0).otherwise(F.least(F.greatest(drop, F.lit(0.0)), F.lit(1.0)))


def _features() -> Column:
    """Structs (feature, drift) in the order of the features."""

    def one(name: str, i: int) -> Column:
        std = F.greatest(F.get("feature_std", F.lit(i)), F.lit(SMALL))
        ratio = F.abs(F.log(F.greatest(F.coalesce(F.get("seen_std", F.lit(i)), F.lit(0.0)), F.lit(SMALL)) / std))
        drift = 0.7 * F.abs(F.get("seen_mean", F.lit(i)) - F.get("feature_mean", F.lit(i))) / std + 0.3 * ratio
        return F.struct(F.lit(name).alias("feature"), F.when(F.col("n") < LEAST_ROWS, 0.0).otherwise(drift).alias("drift"))

    return F.array(*(one(f, i) for i, f in enumerate(FEATURES)))


def _with_models(recent: DataFrame, models: DataFrame, k: int) -> DataFrame:
    """evidence() beside each symbol's model; a symbol without a model falls out. Models are one row a symbol, as the evidence is."""
    return evidence(recent, k).join(models.select("symbol", "transition_matrix", "feature_mean", "feature_std", "metadata"), "symbol")


def occupancy(recent: DataFrame, k: int) -> DataFrame:
    """symbol, occupancy_drift: chi-square distance of the state counts from equal ones, by n and k."""
    return evidence(recent, k).select("symbol", _occupancy(k).alias("occupancy_drift"))


def transitions(recent: DataFrame, models: DataFrame, k: int = 3) -> DataFrame:
    """symbol, transition_drift: Kullback-Leibler divergence of the observed state changes from the model's matrix, by k."""
    return _with_models(recent, models, k).select("symbol", _transitions().alias("transition_drift"))


def likelihood_drop(recent: DataFrame, models: DataFrame, baseline: str = "per_bar") -> DataFrame:
    """symbol, likelihood_drop: how far the mean likelihood of a bar lies below the training's, in [0, 1].

    baseline 'per_bar' divides the model's total by its training bars; 'total' takes it as it is.
    """
    return _with_models(recent, models, 1).select("symbol", _likelihood(baseline).alias("likelihood_drop"))


def feature_drift(recent: DataFrame, models: DataFrame) -> DataFrame:
    """symbol, feature, drift: shift of the mean in training deviations, and the log ratio of deviations, weighed 0.7 and 0.3."""
    return _with_models(recent, models, 1).select("symbol", F.explode(_features()).alias("x")).select("symbol", "x.feature", "x.drift")


def _measured(rows: DataFrame, k: int, window: int, baseline: str, *keys: str) -> DataFrame:
    """keys, n, the four measures to four places (feature drifts as a map) and ready, of rows of evidence beside their models."""
    drifts = F.map_from_entries(F.transform(_features(), lambda x: F.struct(x["feature"], F.round(x["drift"], 4))))
    rounded = {"occupancy_drift": _occupancy(k), "transition_drift": _transitions(), "likelihood_drop": _likelihood(baseline)}
    return rows.select(*keys, "n", *(F.round(x, 4).alias(name) for name, x in rounded.items()), drifts.alias("feature_drift"), (F.col("n") >= min(READY, window)).alias("ready"))


def metrics(scored: DataFrame, models: DataFrame, k: int, window: int = WINDOW, baseline: str = "per_bar") -> DataFrame:
    """One row a symbol: n, ready and the four measures to four places; feature drifts as a map. One pass over the last `window` rows."""
    return _measured(_with_models(latest(scored, window), models, k), k, window, baseline, "symbol")


def rolling_evidence(scored: DataFrame, k: int, window: int = WINDOW, rows: int = BUCKET) -> DataFrame:
    """For every row of scored (symbol, ts, seq, bar_no, state, step_ll, features by name) what evidence() says of the `window` rows up to it.

    Counts and sums slide as differences of running ones, in buckets that repeat `window` rows: the cost of a row does not depend on
    the window, and no series meets in one task. A deviation too small for the sums' precision counts as 0.
    """
    order = Window.partitionBy("symbol", "bucket").orderBy("bar_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    spread = by_halo(scored, rows, window).withColumn("__from", F.lag("state").over(order))
    state = lambda i: F.col("state") == i
    summed = {"n": F.lit(1), "ll": F.col("step_ll")}
    summed |= {f"c{i}": state(i).cast("int") for i in range(k)}
    summed |= {f"m{i}_{j}": F.coalesce((F.col("__from") == i) & state(j), F.lit(False)).cast("int") for i in range(k) for j in range(k)}
    summed |= {f"s{i}": F.col(f) for i, f in enumerate(FEATURES)} | {f"q{i}": F.col(f) * F.col(f) for i, f in enumerate(FEATURES)}
    spread = spread.withColumns({f"__{name}": F.sum(x).over(upto) for name, x in summed.items()})
    # A window's first row has no row before it: of changes between rows there is one less.
    behind = lambda name: window - 1 if name.startswith("m") else window
    slid = lambda name: F.col(f"__{name}") - F.coalesce(F.lag(f"__{name}", behind(name)).over(order), F.lit(0))
    found = spread.withColumns({f"__w_{name}": slid(name) for name in summed}).where(~F.col("in_halo"))
    w = lambda name: F.col(f"__w_{name}")
    n = w("n")
    means = [w(f"s{i}") / n for i in range(len(FEATURES))]
    spreads = [w(f"q{i}") / n - m * m for i, m in enumerate(means)]
    deviations = [F.when(n > 1, F.sqrt(F.when(v > 1e-11 * w(f"q{i}") / n, v).otherwise(0.0) * n / (n - 1))) for i, v in enumerate(spreads)]
    return found.select(
        "symbol", "ts", "seq", "bar_no", n.alias("n"), F.array(*(w(f"c{i}") for i in range(k))).alias("c"), F.array(*(w(f"m{i}_{j}") for i in range(k) for j in range(k))).alias("moves"),
        (w("ll") / n).alias("mean_ll"), F.array(*means).alias("seen_mean"), F.array(*deviations).alias("seen_std"),
    )


def rolling_metrics(scored: DataFrame, models: DataFrame, k: int, window: int = WINDOW, baseline: str = "per_bar", rows: int = BUCKET) -> DataFrame:
    """metrics() after every row: symbol, ts, seq, bar_no, n, the measures and ready, of the `window` rows up to it; as the stream has them."""
    own = models.select("symbol", "transition_matrix", "feature_mean", "feature_std", "metadata")
    met = small_join(rolling_evidence(scored, k, window, rows), own, ["symbol"], limit=MODELS)
    return _measured(met, k, window, baseline, "symbol", "ts", "seq", "bar_no")


def decision(measured: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """measured with reasons and retrain; of the features only the first that drifts is named."""
    first = F.filter(F.array(*(F.lit(f) for f in FEATURES)), lambda f: F.try_element_at(F.col("feature_drift"), f) > thresholds["feature"])
    said = lambda name, column: F.when(F.col(column) > thresholds[name], F.lit(name))
    reasons = F.array_compact(F.array(said("occupancy", "occupancy_drift"), said("transition", "transition_drift"), said("likelihood", "likelihood_drop"), F.when(F.size(first) > 0, F.concat(F.lit("feature:"), F.try_element_at(first, F.lit(1))))))
    reasons = F.when(F.col("ready"), reasons).otherwise(F.array().cast("array<string>"))
    return measured.withColumn("reasons", reasons).withColumn("retrain", F.size("reasons") > 0)


def to_retrain(decided: DataFrame, bars: DataFrame) -> DataFrame:
    """The bars of the symbols whose models are to be trained again."""
    due = stored(decided.where("retrain").select("symbol"), "to-retrain")
    return small_join(bars, due, ["symbol"], "left_semi")

