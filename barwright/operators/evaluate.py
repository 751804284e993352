"""Walk-forward evaluation: windows over each series, models fitted on one part and judged on the next."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import regime_label
from barwright.operators import fit
from barwright.operators.features import BUCKET, by_halo
from barwright.plans import scan
from barwright.sources.shared import small_join, stored

TRAIN, TEST, STEP = 2000, 500, 500
#: Fitted models that one broadcast may hold.
MODELS = 20_000


def window_plan(rows: DataFrame, train: int = TRAIN, test: int = TEST, step: int = STEP) -> DataFrame:
    """symbol, window_idx, start, train_end, test_end: windows while they fit into the symbol's rows."""
    n = rows.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= train + test)
    starts = n.select("symbol", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - train - test, F.lit(step).cast("long"))).alias("window_idx", "start"))
    return starts.select("symbol", "window_idx", "start", (F.col("start") + train).alias("train_end"), (F.col("start") + train + test).alias("test_end"))


def assign(rows: DataFrame, train: int = TRAIN, test: int = TEST, step: int = STEP, number: str = "bar_no") -> DataFrame:
    """rows once for each window that holds them, with window_idx and part ('train' or 'test').

    The range join is arithmetic: a row's windows follow from its number, and the plan, one row a window, drops those that do
    not fit. `number` counts each symbol's rows from 0.
    """
    span = train + test
    last, first = F.floor(F.col(number) / step), F.greatest(F.lit(0), F.ceil((F.col(number) - (span - 1)) / step))
    spread = rows.withColumn("window_idx", F.explode(F.when(first <= last, F.sequence(first, last).cast("array<int>"))))
    plan = window_plan(rows, train, test, step).select("symbol", F.col("window_idx"), "start", "train_end")
    joined = spread.join(plan, ["symbol", "window_idx"])
    return joined.withColumn("part", F.when(F.col(number) < F.col("train_end"), "train").otherwise("test")).drop("start", "train_end")


def stability(states: DataFrame, *by: str, order: str = "bar_no", rows: int = BUCKET) -> DataFrame:
    """by (symbol), stability: the share of rows with the state of the row before them; 1 for a single row.

    By symbol, with order a number that runs on, it works in buckets of `rows` rows that repeat the one before them; by other
    keys (windows of a walk-forward) each group is one window.
    """
    keys = list(by or ("symbol",))
    if keys == ["symbol"] and order == "bar_no":
        states = by_halo(states, rows, 1)
        same = F.col("state") == F.lag("state").over(Window.partitionBy("symbol", "bucket").orderBy(order))
        found = states.withColumn("__same", same.cast("double")).where("not in_halo")
    else:
        same = F.col("state") == F.lag("state").over(Window.partitionBy(*keys).orderBy(order))
        found = states.withColumn("__same", same.cast("double"))
    return found.groupBy(*keys).agg(F.coalesce(F.avg("__same"), F.lit(1.0)).alias("stability"))


def dominant(states: DataFrame, *by: str, k: int = 3) -> DataFrame:
    """by, dominant_state, dominant_regime: the most frequent state, the lowest of equals."""
    by = by or ("symbol",)
    counts = states.groupBy(*by, "state").agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.max_by("state", F.struct("n", -F.col("state"))).alias("dominant_state"))
    return top.withColumn("dominant_regime", regime_label(F.col("dominant_state"), k))


def test_scores(assigned: DataFrame, fitted: DataFrame, number: str = "bar_no") -> DataFrame:
    """symbol, window_idx, bar_no, state, step_ll of the test rows, scored and decoded with their window's model."""
    models = fitted.select("symbol", "window_idx", "initial_probs", "transition_matrix", "means", "variances")
    test = small_join(assigned.where("part = 'test'").select("symbol", "window_idx", number, "features"), models, ["symbol", "window_idx"], limit=MODELS)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(number)
        x = np.array(part["features"].tolist(), float)
        initial, move, means, variances = (np.array(list(map(np.asarray, part[c].iloc[0])), float) for c in ("initial_probs", "transition_matrix", "means", "variances"))
        log_e = scan.log_density(x, means, variances)
        alpha, steps, best, back = initial, [], None, []
        log_move = np.log(np.maximum(move, 1e-300))
        for t, e in enumerate(log_e):
            joint = np.log(np.maximum(alpha @ move if t else alpha, 1e-300)) + e
            top = joint.max()
            weights = np.exp(joint - top)
            steps.append(top + np.log(weights.sum()))
            alpha = weights / weights.sum()
            if best is None:
                best = np.log(np.maximum(initial, 1e-300)) + e
                back.append(np.zeros(len(e), int))
            else:
                both = best[:, None] + log_move
                back.append(both.argmax(axis=0))
                best = both.max(axis=0) + e
        state, path = int(best.argmax()), []
        for came in back[::-1]:
            path.append(state)
            state = int(came[state])
        return pd.DataFrame({"symbol": part["symbol"], "window_idx": part["window_idx"], number: part[number], "state": np.array(path[::-1], np.int32), "step_ll": steps})

    kind = assigned.schema[number].dataType.simpleString()
    return test.groupBy("symbol", "window_idx").applyInPandas(run, f"symbol string, window_idx int, {number} {kind}, state int, step_ll double")


def walk_forward(featured: DataFrame, k: int = 3, train: int = TRAIN, test: int = TEST, step: int = STEP, restarts: int = fit.RESTARTS, **training) -> tuple[DataFrame, DataFrame]:
    """(windows, summary) over all symbols of rows (symbol, bar_no from 0, features); too little data gives no rows."""
    assigned = assign(featured.select("symbol", "bar_no", "features"), train, test, step)
    keys = ["symbol", "window_idx"]
    fitted = stored(fit.best(fit.fits(assigned.where("part = 'train'"), keys, k, restarts, **training), keys), "fits")
    return judged(featured, assigned, fitted, k, train, test, step)


def judged(featured: DataFrame, assigned: DataFrame, fitted: DataFrame, k: int = 3, train: int = TRAIN, test: int = TEST, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """(windows, summary) of models that are there already: fitted has a row for each symbol and window_idx with its parameters and
    log_likelihood, assigned is assign() of featured. Windows without a model are left out."""
    keys = ["symbol", "window_idx"]
    scored = test_scores(assigned, fitted)
    likelihoods = scored.groupBy(*keys).agg(F.sum("step_ll").alias("test_ll"))
    windows = (
        window_plan(featured, train, test, step)
        .join(fitted.select(*keys, F.col("log_likelihood").alias("train_ll")), keys)
        .join(likelihoods, keys)
        .join(stability(scored, *keys), keys)
        .join(dominant(scored, *keys, k=k), keys)
    )
    summary = windows.groupBy("symbol").agg(F.avg("test_ll").alias("mean_test_ll"), F.avg("stability").alias("mean_stability"), F.count("*").alias("n_windows"))
    return windows, summary
