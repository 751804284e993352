"""Blocked scans: order-dependent recursions over one long series, run in parallel by blocks of bars.

A recursion is given as a Scan. Each block is summarised on its own; the summaries, one row a block, are combined in order to give
each block the state it starts with; then each block is replayed from that state in the recursion's own order. All columns
travel with the rows, so both passes read one shuffle and nothing is joined back. Within a block the kernels work on short
chunks side by side, as arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import VARIANCE_FLOOR
from barwright.sources.shared import stored

#: Bars of a block, and of the chunks that a kernel works on side by side.
BLOCK, CHUNK = 4096, 64
#: Fixed floor of a predicted probability. Where every transition is at least TINY it cannot act: a prediction mixes transitions.
FLOOR, TINY = 1e-300, 1e-280
#: States whose outlooks differ by no more lead to the same results.
SAME = 1e-9


@dataclass(frozen=True)
class Scan:
    """One recursion. State and summary are lists of floats; tables hold one block in the order of bar_no.

    summarise(table) -> summary; advance(state, summary) -> the state after the block; replay(table, state) -> dict of columns,
    one value a row; start is the state before the first bar. bound(parameters) is the scan with a series' own parameters.
    Where `exact` is False, advance only guesses: end(table, state) is the state after a block as the replay has it, and
    outlook(state) holds all that later bars see of a state.
    """

    start: Any
    columns: dict[str, str]

    @property
    def exact(self) -> bool:
        return True

    def bound(self, parameters: dict) -> Scan:
        raise NotImplementedError

    def summarise(self, table: pa.Table) -> list[float]:
        raise NotImplementedError

    def advance(self, state: list[float], summary: list[float]) -> list[float]:
        raise NotImplementedError

    def replay(self, table: pa.Table, state: list[float]) -> dict[str, Any]:
        raise NotImplementedError

    def end(self, table: pa.Table, state: list[float]) -> list[float]:
        raise NotImplementedError

    def outlook(self, state: list[float]) -> list[float]:
        raise NotImplementedError


def blocked(frame: DataFrame, scan: Scan, keys: list[str], block: int = BLOCK, backward: bool = False, parameters: str | None = None, exact: bool | None = None) -> DataFrame:
    """frame (keys, bar_no, what the scan reads, others) with the scan's columns. bar_no numbers each series from 0 without gaps or repeats.

    backward runs the blocks from the last to the first; a backward scan's kernels go from the last row of a block to its first.
    parameters names a struct column that holds a series' own parameters in the first row of each of its blocks (in others it
    may be null); it is dropped. Where the scan, or `exact`, says that chained states are guesses, _settled makes them true.
    """
    rows = frame.withColumn("__block", F.floor(F.col("bar_no") / block).cast("long"))
    exact = scan.exact if exact is None else exact
    if not exact:
        rows = stored(rows, "scan-rows")
    by = [*keys, "__block"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    order = "descending" if backward else "ascending"

    def own(table: pa.Table) -> Scan:
        """The scan of a block, whose rows are in order."""
        return scan.bound(table.column(parameters)[0].as_py()) if parameters else scan

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_no")
        bound = own(table)
        return _row(table.select(by), summary=bound.summarise(table), start=bound.start)

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__block", order)])
        state, states = table.column("start")[0].as_py(), []
        for summary in table.column("summary"):
            states.append([float(x) for x in state])
            state = scan.advance(state, summary.as_py())
        return table.select(by).append_column("state", pa.array(states, pa.list_(pa.float64())))

    out = pa_types(scan.columns)

    def replay(table: pa.Table, state: pa.Table) -> pa.Table:
        table = table.sort_by("bar_no")
        found = own(table).replay(table, state.column("state")[0].as_py()) if len(table) else {c: [] for c in out}
        table = table.drop_columns(["__block", *([parameters] if parameters else [])])
        for name, kind in out.items():
            table = table.append_column(name, _column(found[name], kind))
        return table

    grouped = rows.groupBy(*by)
    states = grouped.applyInArrow(summarise, f"{head}, summary array<double>, start array<double>").groupBy(*keys).applyInArrow(chain, f"{head}, state array<double>")
    if not exact:
        states = _settled(rows, states, own, keys, head)
    schema = ", ".join([*(f"`{f.name}` {kinds[f.name]}" for f in frame.schema.fields if f.name != parameters), *(f"`{c}` {t}" for c, t in scan.columns.items())])
    return grouped.cogroup(states.groupBy(*by)).applyInArrow(replay, schema)


def _row(keys: pa.Table, **lists: Any) -> pa.Table:
    """The first row of a table of keys, with columns of lists of floats."""
    found = keys.slice(0, 1)
    for name, values in lists.items():
        found = found.append_column(name, pa.array([[float(x) for x in values]] if len(found) else [], pa.list_(pa.float64())))
    return found


def _settled(rows: DataFrame, guesses: DataFrame, own: Callable, keys: list[str], head: str) -> DataFrame:
    """The true start of every block: blocks are run from their guesses and report where they end, and those whose start is not
    what the block before them ends with are run again from there, until none is left.

    A turn settles the first wrong block of each series and all whose wrong start is soon forgotten; it reads only the blocks
    that run again. Between blocks only states travel, one row a block.
    """
    by = [*keys, "__block"]

    def run(table: pa.Table, state: pa.Table) -> pa.Table:
        if not len(table) or not len(state):
            return _row((table if len(table) else state).select(by).slice(0, 0), state=[], end=[], before=[], after=[])
        table, start = table.sort_by("bar_no"), state.column("state")[0].as_py()
        bound = own(table)
        end = bound.end(table, start)
        return _row(table.select(by), state=start, end=end, before=bound.outlook(start), after=bound.outlook(end))

    kind = f"{head}, state array<double>, end array<double>, before array<double>, after array<double>"
    ends = stored(rows.groupBy(*by).cogroup(guesses.groupBy(*by)).applyInArrow(run, kind), "block-ends")
    # One row a block: the number of blocks, not of bars, bounds this window.
    series = Window.partitionBy(*keys).orderBy("__block")
    apart = F.exists(F.zip_with("before", "__after", lambda a, b: F.abs(a - b)), lambda x: x > SAME)
    while True:
        checked = ends.withColumns({"__end": F.lag("end").over(series), "__after": F.lag("after").over(series)})
        again = stored(checked.where(F.col("__after").isNotNull() & apart).select(*by, F.col("__end").alias("state")), "blocks-again")
        if not again.limit(1).count():
            return ends.select(*by, "state")
        part = rows.join(again.select(*by), by, "left_semi")
        new = part.groupBy(*by).cogroup(again.groupBy(*by)).applyInArrow(run, kind)
        ends = stored(ends.join(again.select(*by), by, "left_anti").unionByName(new), "block-ends")


_ARROW = {"double": pa.float64(), "int": pa.int32(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}


def pa_types(columns: dict[str, str]) -> dict[str, pa.DataType]:
    return {name: _ARROW[kind] for name, kind in columns.items()}


def _column(values: Any, kind: pa.DataType) -> pa.Array:
    """A column from a list or an array; a matrix gives a list a row."""
    if isinstance(values, np.ndarray) and values.ndim == 2:
        flat = pa.array(np.ascontiguousarray(values).ravel(), kind.value_type)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), flat)
    return pa.array(values, kind)


def matrix(table: pa.Table, name: str, kind: Any = float) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def chunks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows dealt out to chunks of CHUNK rows (the last one filled up with zeros), and how many rows each chunk has."""
    n = len(values)
    count = -(-n // CHUNK)
    out = np.zeros((count * CHUNK, values.shape[1]))
    out[:n] = values
    sizes = np.full(count, CHUNK)
    sizes[-1] = n - CHUNK * (count - 1)
    return out.reshape(count, CHUNK, -1), sizes


def through(state: np.ndarray, product: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, float]:
    """A distribution after a stretch given as rows that sum to 1 and the logarithms of what they were divided by; and its log weight."""
    with np.errstate(divide="ignore"):
        weights = np.log(state) + logs
    top = weights.max()
    out = np.exp(weights - top) @ product
    total = out.sum()
    return out / total, float(top + np.log(total))


def _usable(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest log emission of each bar, and whether it is a number; where it is not, any state becomes uniform."""
    with np.errstate(invalid="ignore"):
        top = cut.max(axis=2, keepdims=True)
    return top, np.isfinite(top[:, :, 0])


def products(e: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk the product of its transition and emission matrices, by rows that sum to 1, and the rows' log weights.

    The floor is added to the transitions: as a distribution sums to 1, that adds it to each prediction. It differs from
    the floor as a maximum only for predictions about as small as the floor itself.
    """
    cut, sizes = chunks(e)
    top, usable = _usable(cut)
    with np.errstate(all="ignore"):
        weights = np.exp(cut - top)
        k = e.shape[1]
        total, logs = np.tile(np.eye(k), (len(cut), 1, 1)), np.zeros((len(cut), k))
        for t in range(CHUNK):
            live, good = t < sizes, usable[:, t, None]
            new = np.where(good[:, :, None], (total @ (move + FLOOR)) * weights[:, t, None, :], 1 / k)
            scale = new.sum(axis=2)
            total = np.where(live[:, None, None], new / scale[:, :, None], total)
            logs += np.where(live[:, None] & good, np.log(scale) + top[:, t], 0.0)
    return total, logs


def plain_filter(e: np.ndarray, move: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward filter bar by bar, with its floor, and uniform where every state underflows."""
    k = e.shape[1]
    out, steps = np.empty((len(e), k)), np.empty(len(e))
    for t, row in enumerate(e):
        with np.errstate(all="ignore"):
            joint = np.log(np.maximum(alpha @ move, FLOOR)) + row
            top = joint.max()
            weights = np.exp(joint - top) if np.isfinite(top) else np.zeros(k)
            total = weights.sum()
        good = bool(np.isfinite(total) and total > 0)
        alpha = weights / total if good else np.full(k, 1 / k)
        out[t], steps[t] = alpha, top + np.log(total) if good else 0.0
    return out, steps


def log_density(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Log densities of rows under diagonal Gaussians, one column a state; variances have a floor."""
    v = np.maximum(variances, VARIANCE_FLOOR)
    return -0.5 * (x.shape[1] * np.log(2 * np.pi) + np.log(v).sum(axis=1) + (((x[:, None, :] - means) ** 2) / v).sum(axis=2))


def _emission(table: pa.Table, means: tuple, variances: tuple) -> np.ndarray:
    """The bars' log emissions: a column, or from their features where the scan is bound to a series' own model."""
    return log_density(matrix(table, "features"), np.array(means), np.array(variances)) if means else matrix(table, "log_emission")


def _rows(x: Any) -> tuple[tuple[float, ...], ...]:
    return tuple(tuple(map(float, row)) for row in x)


@dataclass(frozen=True)
class Forward(Scan):
    """Forward filter of a hidden Markov model: predict, weigh, normalise.

    Tables hold `log_emission`, an array of k values a bar, or `features` where the scan is bound to a model. A block's summary
    is the product of its transition-and-emission matrices. With transitions below TINY the filter's floor may act, and what is
    chained are guesses; within a block chunks whose start turns out wrong are gone through bar by bar.
    """

    transition: tuple[tuple[float, ...], ...] = ()
    means: tuple[tuple[float, ...], ...] = ()
    variances: tuple[tuple[float, ...], ...] = ()

    @property
    def exact(self):
        return all(p >= TINY for row in self.transition for p in row)

    def bound(self, parameters):
        return replace(self, start=list(parameters["initial_probs"]), **{f: _rows(parameters[n]) for f, n in (("transition", "transition_matrix"), ("means", "means"), ("variances", "variances"))})

    def summarise(self, table):
        product, logs = products(_emission(table, self.means, self.variances), np.array(self.transition))
        k = len(self.transition)
        whole, scale = np.eye(k), np.zeros(k)
        for p, g in zip(product, logs, strict=True):
            whole, steps = zip(*(through(row, p, g) for row in whole), strict=True)
            scale = scale + np.array(steps)
        return [*np.ravel(whole), *scale]

    def advance(self, state, summary):
        k, rest = len(state), np.array(summary)
        return through(np.asarray(state), rest[: k**2].reshape(k, k), rest[k**2 :])[0].tolist()

    def outlook(self, state):
        return np.log(np.maximum(np.asarray(state) @ np.array(self.transition), FLOOR)).tolist()

    def end(self, table, state):
        return self._run(table, state)[0][-1].tolist()

    def replay(self, table, state):
        found, steps = self._run(table, state)
        return {"state_probs": found, "step_ll": steps}

    def _run(self, table, state):
        e, move, alpha = _emission(table, self.means, self.variances), np.array(self.transition), np.asarray(state, float)
        product, logs = products(e, move)
        starts = [alpha]
        for p, g in zip(product[:-1], logs[:-1], strict=True):
            starts.append(through(starts[-1], p, g)[0])
        cut, _ = chunks(e)
        _, usable = _usable(cut)
        k = e.shape[1]
        alpha, found, steps = np.array(starts), np.empty(cut.shape), np.empty(cut.shape[:2])
        for t in range(CHUNK):
            with np.errstate(all="ignore"):
                joint = np.log(np.maximum(alpha @ move, FLOOR)) + cut[:, t]
                top = joint.max(axis=1, keepdims=True)
                weights = np.exp(joint - top)
                total = weights.sum(axis=1, keepdims=True)
                good = usable[:, t, None]
                alpha = found[:, t] = np.where(good, weights / total, 1 / k)
                steps[:, t] = np.where(good, top + np.log(total), 0.0)[:, 0]
        ends = found[:-1, -1]
        found, steps = found.reshape(-1, k)[: len(e)], steps.ravel()[: len(e)]
        if not self.exact and len(ends):
            outlook = lambda a: np.log(np.maximum(a @ move, FLOOR))
            wrong = np.flatnonzero((np.abs(outlook(ends) - outlook(np.array(starts[1:]))) > SAME).any(axis=1))
            if len(wrong):
                at = (int(wrong[0]) + 1) * CHUNK
                found[at:], steps[at:] = plain_filter(e[at:], move, ends[wrong[0]])
        return found, steps


def forward(model: dict | None = None) -> Forward:
    """The filter of one model, over log emissions, or with None one that is bound to each series' own."""
    columns = {"state_probs": "array<double>", "step_ll": "double"}
    return Forward(start=list(model["initial_probs"]) if model else [], columns=columns, transition=_rows(model["transition_matrix"]) if model else ())


_NONE = -1e300


@dataclass(frozen=True)
class MaxPlus(Scan):
    """Scores of the best path to each state: each bar's best predecessor of every state and its own best state (first of equals)."""

    log_initial: tuple[float, ...] = ()
    log_transition: tuple[tuple[float, ...], ...] = ()
    means: tuple[tuple[float, ...], ...] = ()
    variances: tuple[tuple[float, ...], ...] = ()

    def bound(self, parameters):
        return replace(max_plus(parameters), means=_rows(parameters["means"]), variances=_rows(parameters["variances"]))

    def _products(self, table):
        e, move = _emission(table, self.means, self.variances), np.array(self.log_transition)
        cut, sizes = chunks(e)
        total = np.tile(np.where(np.eye(len(move), dtype=bool), 0.0, _NONE), (len(cut), 1, 1))
        for t in range(CHUNK):
            new = (total[:, :, :, None] + move).max(axis=2) + cut[:, t, None, :]
            if t == 0 and table.column("bar_no")[0].as_py() == 0:  # every state before the first bar leads to the initial scores
                new[0] = np.array(self.log_initial) + cut[0, 0]
            total = np.where((t < sizes)[:, None, None], new, total)
        return cut, move, total

    def summarise(self, table):
        _, _, product = self._products(table)
        whole = product[0]
        for p in product[1:]:
            whole = (whole[:, :, None] + p).max(axis=1)
        return whole.ravel()

    def advance(self, state, summary):
        return (np.asarray(state)[:, None] + np.asarray(summary).reshape(len(state), -1)).max(axis=0).tolist()

    def replay(self, table, state):
        cut, move, product = self._products(table)
        starts = [np.asarray(state, float)]
        for p in product[:-1]:
            starts.append((starts[-1][:, None] + p).max(axis=0))
        score, came, best = np.array(starts), np.zeros(cut.shape, np.int32), np.empty(cut.shape[:2], np.int32)
        for t in range(CHUNK):
            both = score[:, :, None] + move
            score, came[:, t] = both.max(axis=1) + cut[:, t], both.argmax(axis=1)
            if t == 0 and table.column("bar_no")[0].as_py() == 0:
                score[0], came[0, 0] = np.array(self.log_initial) + cut[0, 0], 0
            best[:, t] = score.argmax(axis=1)
        n = len(table)
        return {"came_from": came.reshape(-1, len(move))[:n], "best_end": best.ravel()[:n]}


def max_plus(model: dict | None = None) -> MaxPlus:
    """The best paths' scan of one model, over log emissions, or with None one that is bound to each series' own."""
    columns = {"came_from": "array<int>", "best_end": "int"}
    if model is None:
        return MaxPlus(start=[], columns=columns)
    log = lambda x: float(np.log(max(x, FLOOR)))
    return MaxPlus(start=[0.0] * len(model["initial_probs"]), columns=columns, log_initial=tuple(map(log, model["initial_probs"])), log_transition=tuple(tuple(map(log, row)) for row in model["transition_matrix"]))


@dataclass(frozen=True)
class Trace(Scan):
    """The best path read from its end: each bar's state from the next bar's predecessor table. Run backward.

    The state carried is the state of the bar at hand (-1 marks the end of the series, the last entry of a summary). Tables hold
    came_from and best_end.
    """

    def summarise(self, table):
        came, last = matrix(table, "came_from", int), table.column("best_end")[-1].as_py()
        reached = np.array([*range(came.shape[1]), last])
        for row in came[::-1]:
            reached = row[reached]
        return reached

    def advance(self, state, summary):
        return [summary[int(state[0])]]

    def replay(self, table, state):
        came, at, path = matrix(table, "came_from", int).tolist(), int(state[0]), []
        if at < 0:
            at = table.column("best_end")[-1].as_py()
        for row in reversed(came):
            path.append(at)
            at = row[at]
        return {"state": np.array(path[::-1], np.int32)}


def trace() -> Trace:
    return Trace(start=[-1.0], columns={"state": "int"})


@dataclass(frozen=True)
class Automaton(Scan):
    """A finite automaton over `__code`, a number a row, that enters each period anew. A block's summary is the table of its end states.

    table[state][code] is the next state, reset[state] the state in which a new period begins; a period is a run of equal
    `__period` (a double). The state carried is the automaton's and the period it was reached in. Each column of the result
    reads a list by the state reached.
    """

    table: tuple[tuple[int, ...], ...] = ()
    reset: tuple[int, ...] = ()
    read: tuple[tuple[Any, ...], ...] = ()

    def _inputs(self, table):
        period = table.column("__period").to_numpy()
        return table.column("__code").to_numpy(), period, np.concatenate(([False], period[1:] != period[:-1]))

    def summarise(self, table):
        codes, period, new = self._inputs(table)
        steps, reset = np.array(self.table).T, np.array(self.reset)
        reached = np.arange(len(self.table))
        for code, anew in zip(codes.tolist(), new.tolist(), strict=True):
            reached = steps[code][reset[reached] if anew else reached]
        return [period[0], period[-1], *reached]

    def advance(self, state, summary):
        at = int(state[0]) if state[1] == summary[0] else self.reset[int(state[0])]
        return [summary[2 + at], summary[1]]

    def replay(self, table, state):
        codes, period, new = self._inputs(table)
        at, path = int(state[0]), []
        new[0] = state[1] != period[0]
        for code, anew in zip(codes.tolist(), new.tolist(), strict=True):
            at = self.table[self.reset[at] if anew else at][code]
            path.append(at)
        return {name: [values[at] for at in path] for name, values in zip(self.columns, self.read, strict=True)}
