"""Training of Gaussian hidden Markov models: many fits at once, one task a fit, and canonical model rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.scalar import LABELS, SMALL, VARIANCE_FLOOR
from barwright.plans import scan
from barwright.sources.schema import MODEL
from barwright.sources.shared import small_join, stored

#: Fixed training parameters: iterations, tolerance of the likelihood, restarts; restart r has seed 42 r + 1.
ITERATIONS, TOLERANCE, RESTARTS = 200, 1e-4, 5
#: Rows of a series beyond which one task does not fit it alone.
LONG = 1_000_000

FIT = "k int, restart int, initial_probs array<double>, transition_matrix array<array<double>>, means array<array<double>>, variances array<array<double>>, log_likelihood double, converged boolean, n_iterations int, n_rows bigint"


def chunk_products(e: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emissions in chunks, which of their bars are real, and each chunk's product of transitions and emissions, scaled as a whole;
    the first bar of all has the matrix `first` in place of its transitions."""
    cut, sizes = scan.chunks(e)
    live = np.arange(scan.CHUNK)[None, :] < sizes[:, None]
    cut[~live] = 1.0
    product = np.tile(np.eye(e.shape[1]), (len(cut), 1, 1))
    for t in range(scan.CHUNK):
        step = np.broadcast_to(move, product.shape)
        if t == 0:
            step = step.copy()
            step[0] = first
        new = (product @ step) * cut[:, t, None, :]
        product = np.where(live[:, t, None, None], new / np.maximum(new.sum(axis=(1, 2), keepdims=True), 1e-300), product)
    return cut, live, product


def forward_backward(log_e: np.ndarray, prediction: np.ndarray, move: np.ndarray, after: np.ndarray):
    """Scaled forward and backward probabilities of a stretch of bars, its scaled emissions, and its log likelihood.

    prediction is what is expected of the first bar, after the weight of each last state by all that follows. Chunks of bars run
    side by side: their products give each chunk the state it starts with and the weight of what follows it.
    """
    n, k = log_e.shape
    top = log_e.max(axis=1, keepdims=True)
    e = np.exp(log_e - top)
    # The first bar's prediction as a matrix: from whatever state, all of its rows are the same.
    cut, live, product = chunk_products(e, move, prediction)
    state, starts = np.full(k, 1 / k), []
    for p in product:
        starts.append(state)
        state = state @ p
        state = state / max(state.sum(), 1e-300)
    ends = []
    for p in product[::-1]:
        ends.append(after)
        after = p @ after
        after = after / max(after.sum(), 1e-300)
    alpha, scale = np.empty(cut.shape), np.ones(cut.shape[:2])
    state = np.array(starts)
    for t in range(scan.CHUNK):
        new = state @ move
        if t == 0:
            new[0] = prediction
        new = new * cut[:, t]
        scale[:, t] = np.maximum(new.sum(axis=1), 1e-300)
        state = alpha[:, t] = new / scale[:, t, None]
    beta, after = np.empty(cut.shape), np.array(ends[::-1])
    for t in range(scan.CHUNK - 1, -1, -1):
        beta[:, t] = after
        new = (cut[:, t] * after) @ move.T
        after = np.where(live[:, t, None], new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300), after)
    alpha, beta = alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n]
    return alpha, beta, e, float(np.log(scale.ravel()[:n]).sum() + top.sum())


def posteriors(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    gamma = alpha * beta
    return gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300)


def pair_posteriors(before: np.ndarray, move: np.ndarray, weighed: np.ndarray) -> np.ndarray:
    """Sum over bars of the posteriors of (state, next state), from forward probabilities and the next bars' emissions and weights."""
    joint = before[:, :, None] * move * weighed[:, None, :]
    return (joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)


def _smooth(log_e: np.ndarray, initial: np.ndarray, move: np.ndarray):
    """State posteriors, summed transition posteriors, log likelihood of a whole series."""
    alpha, beta, e, total = forward_backward(log_e, initial, move, np.ones(len(move)))
    return posteriors(alpha, beta), pair_posteriors(alpha[:-1], move, e[1:] * beta[1:]), total


def maximised(first: np.ndarray, weight: np.ndarray, sums: np.ndarray, squares: np.ndarray, pairs: np.ndarray):
    """Parameters from expected sums: the first bar's posteriors, each state's weight, its sums of x and x squared, its moves."""
    weight = np.maximum(weight, 1e-12)[:, None]
    means = sums / weight
    return first, (pairs + 1e-12) / (pairs + 1e-12).sum(axis=1, keepdims=True), means, np.maximum(squares / weight - means**2, VARIANCE_FLOOR)


def sticky(k: int) -> np.ndarray:
    """Transitions to start from."""
    move = np.full((k, k), 0.1 / max(k - 1, 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)
    return move


def start(x: np.ndarray, k: int, seed: int):
    """Means far from one another, drawn with chances by squared distance; common variances; sticky transitions."""
    random = np.random.default_rng(seed)
    means = [x[random.integers(len(x))]]
    for _ in range(k - 1):
        far = np.min([((x - m) ** 2).sum(axis=1) for m in means], axis=0)
        means.append(x[random.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[random.integers(len(x))])
    variances = np.tile(np.maximum(x.var(axis=0), VARIANCE_FLOOR), (k, 1))
    return np.full(k, 1 / k), sticky(k), np.array(means), variances


def expectation_maximisation(x: np.ndarray, k: int, seed: int, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> dict:
    """One fit; its likelihood never falls from one iteration to the next but for rounding."""
    initial, move, means, variances = start(x, k, seed)
    last, converged, step = -np.inf, False, 0
    for step in range(1, iterations + 1):
        gamma, pairs, total = _smooth(scan.log_density(x, means, variances), initial, move)
        initial, move, means, variances = maximised(gamma[0], gamma.sum(axis=0), gamma.T @ x, gamma.T @ x**2, pairs)
        if total - last < tolerance and step > 1:
            converged = True
            break
        last = total
    _, _, total = _smooth(scan.log_density(x, means, variances), initial, move)
    return {"initial_probs": initial, "transition_matrix": move, "means": means, "variances": variances, "log_likelihood": total, "converged": converged, "n_iterations": step}


def canonical(model: dict) -> dict:
    """States in the order of their total variance; probabilities that sum to 1."""
    rank = np.argsort(np.asarray(model["variances"]).sum(axis=1), kind="stable")
    initial = np.asarray(model["initial_probs"])[rank]
    move = np.asarray(model["transition_matrix"])[np.ix_(rank, rank)]
    out = {"initial_probs": initial / initial.sum(), "transition_matrix": move / move.sum(axis=1, keepdims=True), "means": np.asarray(model["means"])[rank], "variances": np.maximum(np.asarray(model["variances"])[rank], VARIANCE_FLOOR)}
    return model | {name: value.tolist() for name, value in out.items()}


def fits(rows: DataFrame, keys: list[str], k: int = 3, restarts: int = RESTARTS, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, order: str = "bar_no", long: int = LONG) -> DataFrame:
    """keys and FIT columns: one row for each group and restart, canonical. rows: keys, `order`, features.

    Each (group, restart) is a task of its own; groups of fewer rows than states, and fits that fail, give no row. Groups of
    more than `long` rows are fitted in blocks (blocked_fit), with the same result but for rounding.
    """
    from barwright.operators import blocked_fit

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    large = stored(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > long).select(*keys), "long-series")
    some = large.limit(1).count()
    short = small_join(rows, large, keys, "left_anti") if some else rows
    spread = short.select(*keys, order, "features", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        x, restart = np.array(part["features"].tolist(), float), int(part["restart"].iloc[0])
        own = {c: part[c].iloc[0] for c in keys}
        columns = [*own, "k", "restart", "initial_probs", "transition_matrix", "means", "variances", "log_likelihood", "converged", "n_iterations", "n_rows"]
        if len(x) <= k:
            return pd.DataFrame(columns=columns)
        found = canonical(expectation_maximisation(x, k, restart * 42 + 1, iterations, tolerance))
        if not np.isfinite(found["log_likelihood"]):
            return pd.DataFrame(columns=columns)
        return pd.DataFrame([{**own, "k": k, "restart": restart, **found, "n_rows": len(x)}])[columns]

    head = ", ".join(f"{c} {kinds[c]}" for c in keys)
    found = spread.groupBy(*keys, "restart").applyInPandas(run, f"{head}, {FIT}")
    if not some:
        return found
    return found.unionByName(blocked_fit.fits(small_join(rows, large, keys, "left_semi"), keys, k, restarts, iterations, tolerance, order))


def best(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """The fit of each group with the highest likelihood; the first restart of equals."""
    names = [f.split(" ")[0] for f in ("k int", "restart int", "initial_probs x", "transition_matrix x", "means x", "variances x", "log_likelihood x", "converged x", "n_iterations x", "n_rows x")]
    chosen = F.max_by(F.struct(*names), F.struct("log_likelihood", -F.col("restart")))
    return fitted.groupBy(*keys).agg(chosen.alias("__best")).select(*keys, "__best.*")


def models(rows: DataFrame, k: int = 3, restarts: int = RESTARTS, trained_at: str | None = None, **training) -> DataFrame:
    """Model rows for every symbol of rows (symbol, ts, bar_no, features), best of the restarts."""
    chosen = best(fits(rows, ["symbol"], k, restarts, **training), ["symbol"])
    n = 6
    at = lambda f, i: f(F.col("features")[i])
    seen = rows.groupBy("symbol").agg(
        F.array(*(at(F.avg, i) for i in range(n))).alias("feature_mean"),
        F.array(*(F.greatest(F.coalesce(at(F.stddev_samp, i), F.lit(0.0)), F.lit(SMALL)) for i in range(n))).alias("feature_std"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
    )
    labels = F.array(*(F.lit(x) for x in LABELS.get(k, tuple(f"state_{i}" for i in range(k)))))
    now = F.lit(trained_at) if trained_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    metadata = F.struct(
        now.alias("trained_at"), F.col("n_rows").alias("training_bars"), "log_likelihood", "converged", "n_iterations", F.lit(restarts).alias("random_restarts"),
        F.date_format("first", "yyyy-MM-dd").alias("data_start"), F.date_format("last", "yyyy-MM-dd").alias("data_end"),
    )
    joined = chosen.join(seen, "symbol").withColumns({"schema_version": F.lit(2), "n_features": F.lit(n), "regime_labels": labels, "metadata": metadata})
    return joined.select(*(part.split(" ")[0] for part in MODEL.split(", ") if part.split(" ")[0] in joined.columns))


def train_all(bars: DataFrame, featured: DataFrame, k: int = 3, **training) -> tuple[DataFrame, DataFrame]:
    """(models, status): every symbol with bars enough is trained; status says why the others are not."""
    from barwright.operators.features import trainable
    from barwright.operators.quality import training_status

    status = stored(training_status(bars, featured), "training-status")
    usable = small_join(trainable(featured), status.where("status = 'ok'").select("symbol"), ["symbol"], "left_semi")
    return models(usable, k, **training), status
