"""Training on series of any length: expectation maximisation as a loop of Spark jobs over blocks of bars.

A block of a series is one row that holds its features. In each iteration every block gives the product of its transitions and
emissions; chained, one row a block, these tell each block what is expected of its first bar and what follows its last; then
every block gives its expected sums, which are added up for each fit. Parameters and sums are a few numbers a fit; features
never leave their block's row. fit.expectation_maximisation gives the same but for rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import VARIANCE_FLOOR
from barwright.operators import fit
from barwright.plans import scan
from barwright.sources.shared import small_join, stored

BLOCK = 4096
#: Rows of parameters, or of blocks' states, that one broadcast may hold.
SMALL = 100_000
_MATRIX = "array<array<double>>"
PARAMETERS = {"initial_probs": "array<double>", "transition_matrix": _MATRIX, "means": _MATRIX, "variances": _MATRIX}
_DOUBLES = pa.list_(pa.float64())
_ROWS = pa.list_(_DOUBLES)


def blocks_of(rows: DataFrame, keys: list[str], order: str = "bar_no", block: int = BLOCK) -> DataFrame:
    """keys, block, n, x: the features of each block's rows in order, as one array; stored. order must not repeat in a series."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("features").alias("f"))))
    found = rows.groupBy(*keys, F.floor(F.col(order) / block).cast("long").alias("block")).agg(held.alias("h"))
    return stored(found.select(*keys, "block", F.size("h").cast("long").alias("n"), F.flatten(F.transform("h", lambda r: r["f"])).alias("x")), "fit-blocks")


def _names(frame: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    return ", ".join(f"`{c}` {kinds[c]}" for c in keys)


def _mapped(frame: DataFrame, keys: list[str], kernel, columns: dict[str, str]) -> DataFrame:
    """keys and columns of the dicts that kernel(row) gives for each row of frame; the keys are the row's own."""
    types = {"array<double>": _DOUBLES, _MATRIX: _ROWS, "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<boolean>": pa.list_(pa.bool_())}

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                found = list(kernel(row.to_pylist()[0] if "x" not in row.schema.names else {c: row.column(c)[0].as_py() for c in row.schema.names if c != "x"} | {"x": row.column("x").flatten().to_numpy(zero_copy_only=False).reshape(int(row.column("n")[0].as_py()), -1)}))
                own = [row.column(c).take(pa.array([0] * len(found), pa.int64())) for c in keys]
                yield pa.record_batch([*own, *(pa.array([f[c] for f in found], types[t]) for c, t in columns.items())], names=[*keys, *columns])

    return frame.mapInArrow(run, ", ".join([_names(frame, keys), *(f"{c} {t}" for c, t in columns.items())]))


def _with_fits(blocks: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Each block with all fits (restart and parameters) of its series."""
    return small_join(blocks, fitted.groupBy(*keys).agg(F.collect_list(F.struct("restart", *PARAMETERS)).alias("fits")), keys, limit=SMALL)


def _matrices(one: dict) -> tuple[np.ndarray, ...]:
    return tuple(np.array(one[c], float) for c in PARAMETERS)


def _states(blocks: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, states: for each fit what is expected of the block's first bar, the state before it, and what follows the block."""

    def product(row):
        for one in row["fits"]:
            initial, move, means, variances = _matrices(one)
            log_e = scan.log_density(row["x"], means, variances)
            # Without the step into the first bar, which the chain knows.
            _, _, parts = fit.chunk_products(np.exp(log_e - log_e.max(axis=1, keepdims=True)), move, np.eye(len(move)))
            whole = np.eye(len(move))
            for part in parts:
                whole = whole @ part
                whole = whole / max(whole.sum(), 1e-300)
            yield {"restart": one["restart"], "product": whole.tolist(), "initial": initial.tolist(), "move": move.tolist()}

    products = _mapped(_with_fits(blocks, fitted, keys), [*keys, "block"], product, {"restart": "int", "product": _MATRIX, "initial": "array<double>", "move": _MATRIX})

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [np.array(p) for p in table.column("product").to_pylist()]
        initial, move = (np.array(table.column(c)[0].as_py()) for c in ("initial", "move"))
        expected, before, state = [], [], None
        for part in parts:
            before.append([] if state is None else state.tolist())
            expected.append(initial if state is None else state @ move)
            state = expected[-1] @ part
            state = state / max(state.sum(), 1e-300)
        after, weight = [], np.ones(len(move))
        for part in parts[::-1]:
            after.append(weight)
            weight = move @ (part @ weight)
            weight = weight / max(weight.sum(), 1e-300)
        found = table.select([*keys, "block", "restart"])
        for name, values in (("expected", expected), ("before", before), ("after", after[::-1])):
            found = found.append_column(name, pa.array([list(v) for v in values], _DOUBLES))
        return found

    chained = products.groupBy(*keys, "restart").applyInArrow(chain, f"{_names(blocks, keys)}, block long, restart int, expected array<double>, before array<double>, after array<double>")
    return stored(chained.groupBy(*keys, "block").agg(F.collect_list(F.struct("restart", "expected", "before", "after")).alias("states")), "block-states")


def expected_sums(blocks: DataFrame, fitted: DataFrame, keys: list[str], k: int, width: int) -> DataFrame:
    """keys, restart, first, sums: each fit's posteriors of the first bar, and in one array the log likelihood, each state's weight,
    its sums of x and of x squared, and its moves."""

    def expect(row):
        states = {s["restart"]: s for s in row["states"]}
        for one in row["fits"]:
            _, move, means, variances = _matrices(one)
            s = states[one["restart"]]
            alpha, beta, e, total = fit.forward_backward(scan.log_density(row["x"], means, variances), np.array(s["expected"]), move, np.array(s["after"]))
            gamma = fit.posteriors(alpha, beta)
            before = np.array(s["before"]).reshape(-1, k)
            pairs = fit.pair_posteriors(np.concatenate((before, alpha[:-1])), move, (e * beta)[0 if len(before) else 1 :])
            sums = np.concatenate(([total], gamma.sum(axis=0), (gamma.T @ row["x"]).ravel(), (gamma.T @ row["x"] ** 2).ravel(), pairs.ravel()))
            yield {"restart": one["restart"], "first": None if len(before) else gamma[0].tolist(), "sums": sums.tolist()}

    met = small_join(_with_fits(blocks, fitted, keys), _states(blocks, fitted, keys), [*keys, "block"], limit=SMALL)
    found = _mapped(met, keys, expect, {"restart": "int", "first": "array<double>", "sums": "array<double>"})
    total = F.array(*(F.sum(F.col("sums")[i]) for i in range(1 + k + 2 * k * width + k * k)))
    return found.groupBy(*keys, "restart").agg(F.first("first", ignorenulls=True).alias("first"), total.alias("sums"))


def em_step(blocks: DataFrame, fitted: DataFrame, keys: list[str], k: int, width: int) -> DataFrame:
    """keys, restart, the parameters after one step of expectation maximisation, and the log likelihood of those before it."""

    def maximise(row):
        sums = np.array(row["sums"])
        weight, x, squares, pairs = np.split(sums[1:], np.cumsum([k, k * width, k * width]))
        new = fit.maximised(np.array(row["first"]), weight, x.reshape(k, -1), squares.reshape(k, -1), pairs.reshape(k, k))
        yield dict(zip(PARAMETERS, (v.tolist() for v in new), strict=True)) | {"log_likelihood": float(sums[0])}

    return _mapped(expected_sums(blocks, fitted, keys, k, width), [*keys, "restart"], maximise, PARAMETERS | {"log_likelihood": "double"})


def _draw(seed: int, n: int, drawn: int, even: list[bool]) -> float:
    """The number of draw `drawn` of a start: a row's number, or a share of the summed distances; as fit.start draws them."""
    random = np.random.default_rng(seed)
    value = float(random.integers(n))
    for i in range(drawn):
        value = float(random.integers(n)) if even[i] else float(random.random())
    return value


def _picker(at: int, keys: list[str]):
    """For one fit's blocks (far: their sums of distances), the block that holds the next mean, and where in it."""

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        far, n = (np.array(table.column(c).to_pylist(), float) for c in ("far", "n"))
        even = [*(table.column("even")[0].as_py() or [])]
        if at:
            even.append(not far.sum() > 0)
        value = _draw(42 * table.column("restart")[0].as_py() + 1, int(n.sum()), at, even)
        weights = n if not at or even[-1] else far
        value = value if not at or even[-1] else value * far.sum()
        ends = weights.cumsum()
        block = min(int(np.searchsorted(ends, value, side="right")), len(ends) - 1)
        found = table.slice(block, 1).select([*keys, "restart", "block"])
        rest = float(value - (ends[block] - weights[block]))
        return found.append_column("rest", pa.array([rest], pa.float64())).append_column("even", pa.array([even], pa.list_(pa.bool_())))

    return pick


def starts(blocks: DataFrame, keys: list[str], k: int, restarts: int) -> DataFrame:
    """keys, restart and the parameters to start from, as fit.start chooses them: each further mean by squared distance.

    For each mean one pass gives every block's sum of distances, and one fetches the chosen row from its block.
    """
    name = _names(blocks, keys)
    order = Window.partitionBy(*keys).orderBy("block")

    def moments(row):
        x = row["x"]
        yield {"block": row["block"], "n": len(x), "mean": x.mean(axis=0).tolist(), "spread": ((x - x.mean(axis=0)) ** 2).sum(axis=0).tolist()}

    def series(table: pa.Table) -> pa.Table:
        n, mean, spread = (np.array(table.column(c).to_pylist(), float) for c in ("n", "mean", "spread"))
        whole = (n[:, None] * mean).sum(axis=0) / n.sum()
        variance = np.maximum((spread + n[:, None] * (mean - whole) ** 2).sum(axis=0) / n.sum(), VARIANCE_FLOOR)
        return table.select(keys).slice(0, 1).append_column("total", pa.array([int(n.sum())], pa.int64())).append_column("variance", pa.array([variance.tolist()], _DOUBLES))

    parts = stored(_mapped(blocks, keys, moments, {"block": "long", "n": "long", "mean": "array<double>", "spread": "array<double>"}), "moments")
    whole = stored(parts.groupBy(*keys).applyInArrow(series, f"{name}, total long, variance array<double>").where(F.col("total") > k), "series")
    chosen = whole.select(*keys, "total", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1))).alias("restart"), F.array().cast(_MATRIX).alias("means"), F.array().cast("array<boolean>").alias("even"))
    for at in range(k):
        chosen = stored(chosen, "means")
        per_key = chosen.groupBy(*keys).agg(F.collect_list(F.struct("restart", "means")).alias("fits"))

        def distances(row, at=at):
            for one in row["fits"]:
                far = np.min([((row["x"] - np.array(m)) ** 2).sum(axis=1) for m in one["means"]], axis=0) if at else np.ones(len(row["x"]))
                yield {"block": row["block"], "restart": one["restart"], "far": float(far.sum()), "n": len(far)}

        far = _mapped(small_join(blocks, per_key, keys, limit=SMALL), keys, distances, {"block": "long", "restart": "int", "far": "double", "n": "long"})

        placed = far.join(chosen.select(*keys, "restart", "even"), [*keys, "restart"]).groupBy(*keys, "restart").applyInArrow(_picker(at, keys), f"{name}, restart int, block long, rest double, even array<boolean>")
        placed = placed.join(chosen.select(*keys, "restart", "total", "means"), [*keys, "restart"])
        wanted = stored(placed.groupBy(*keys, "block").agg(F.collect_list(F.struct("restart", "rest", "even", "total", "means")).alias("wanted")), "places")

        def fetch(row):
            for one in row["wanted"]:
                if not one["even"] or one["even"][-1]:
                    i = int(one["rest"])
                else:
                    i = int(np.searchsorted(np.min([((row["x"] - np.array(m)) ** 2).sum(axis=1) for m in one["means"]], axis=0).cumsum(), one["rest"], side="right"))
                yield {"restart": one["restart"], "total": one["total"], "even": one["even"], "means": [*one["means"], row["x"][min(i, len(row["x"]) - 1)].tolist()]}

        chosen = _mapped(small_join(blocks, wanted, [*keys, "block"], limit=SMALL).select(*blocks.columns, "wanted"), keys, fetch, {"restart": "int", "total": "long", "even": "array<boolean>", "means": _MATRIX})
    move = F.array(*(F.array(*(F.lit(float(p)) for p in row)) for row in fit.sticky(k)))
    found = chosen.join(whole.select(*keys, "variance"), keys)
    return found.select(*keys, "restart", F.array_repeat(F.lit(1 / k), k).alias("initial_probs"), move.alias("transition_matrix"), "means", F.array_repeat("variance", k).alias("variances"), F.col("total").alias("n_rows"))


def fits(rows: DataFrame, keys: list[str], k: int = 3, restarts: int = fit.RESTARTS, iterations: int = fit.ITERATIONS, tolerance: float = fit.TOLERANCE, order: str = "bar_no", block: int = BLOCK) -> DataFrame:
    """keys and fit.FIT columns: one row for each series and restart, canonical; series of no more rows than states give none.

    Fits that have converged leave the loop; a turn ends with one stored row of parameters a fit.
    """
    blocks = blocks_of(rows, keys, order, block)
    some = blocks.select(F.size("x") / F.col("n")).first()
    width = int(some[0]) if some else 1
    state = {"last": F.lit(None).cast("double"), "n_iterations": F.lit(0), "converged": F.lit(False)}
    fitted = stored(starts(blocks, keys, k, restarts).withColumns(state), "fits")
    own = [*keys, "restart"]
    for step in range(1, iterations + 1):
        active = fitted.where("not converged")
        if not active.limit(1).count():
            break
        new = em_step(blocks, active.select(*own, *PARAMETERS), keys, k, width)
        close = F.lit(step > 1) & (F.col("log_likelihood") - F.col("last") < tolerance)
        new = new.join(active.select(*own, "n_rows", "last"), own).withColumns({"converged": F.coalesce(close, F.lit(False)), "n_iterations": F.lit(step)})
        new = new.withColumn("last", F.col("log_likelihood")).drop("log_likelihood")
        fitted = stored(new.unionByName(fitted.where("converged")), "fits")
    final = expected_sums(blocks, fitted, keys, k, width).select(*own, F.col("sums")[0].alias("log_likelihood"))

    def ordered(row):
        yield {c: v for c, v in fit.canonical({c: row[c] for c in PARAMETERS}).items()}

    sorted_ = _mapped(fitted, own, ordered, PARAMETERS)
    found = sorted_.join(final, own).join(fitted.select(*own, "converged", "n_iterations", "n_rows"), own).where(~F.isnan("log_likelihood") & (F.abs("log_likelihood") < float("inf")))
    return found.select(*keys, F.lit(k).alias("k"), "restart", *PARAMETERS, "log_likelihood", "converged", "n_iterations", F.col("n_rows").cast("long").alias("n_rows"))
