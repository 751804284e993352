"""From regime proposals to decisions: hysteresis, rule-based regimes, signals, stops, sizes and the first gate that blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.scalar import regime_label, regime_signal
from barwright.operators.features import by_halo
from barwright.plans import scan

#: Fixed values of the rule-based classifier and of the stops by regime (stop factor, target factor).
FAST, SLOW, ATR_ROWS, TREND, FADE, RULE_CONFIDENCE = 20, 50, 60, 0.002, 0.005, 0.5
STOP_FACTORS = {0: (0.75, 0.75), 2: (1.5, 1.25)}


def _regime_automaton(states: int, dwell: int, flips: int) -> scan.Automaton:
    """The automaton over (current, candidate, dwell, flips so far), from a state in which no regime is known yet.

    Codes are the proposals 0 .. states - 1, and `states` for none. A new session sets the flips back.
    """
    known = [(current, candidate, count, n) for current in range(states) for candidate in range(states) for count in range(dwell + 1) for n in range(flips + 1)]
    places = {None: 0} | {state: i + 1 for i, state in enumerate(known)}

    def step(state, proposed):
        if proposed == states or state and state[3] >= flips:
            return state
        if state is None:
            return (proposed, proposed, dwell, 0) if flips else None
        current, candidate, count, n = state
        if proposed == current:
            return (current, current, 0, n)
        count = min(count + 1, dwell) if proposed == candidate else 1
        return (proposed, proposed, 0, n + 1) if count >= dwell else (current, proposed, count, n)

    everything = [None, *known]
    return scan.Automaton(
        start=[0.0, float("nan")],
        columns={"regime": "int", "flips": "int"},
        table=tuple(tuple(places[step(s, p)] for p in range(states + 1)) for s in everything),
        reset=tuple(places[s and (*s[:3], 0)] for s in everything),
        read=(tuple(-1 if s is None else s[0] for s in everything), tuple(0 if s is None else s[3] for s in everything)),
    )


def hysteresis(proposals: DataFrame, states: int = 3, confidence: float = 0.55, dwell: int = 3, max_flips: int = 6, block: int = scan.BLOCK) -> DataFrame:
    """proposals (symbol, session_id, bar_no, state, confidence) with regime and flips.

    Proposals below the confidence are ignored; another state must be proposed `dwell` times before the regime follows; a
    session has at most `max_flips` changes; the regime outlives the session. Blocks of bars are reduced to the table of
    their start and end states, and the tables are chained, so neither a long series nor a long session meets in one task.
    """
    own = F.when((F.col("confidence") >= confidence) & F.col("state").between(0, states - 1), F.col("state")).otherwise(states)
    rows = proposals.withColumns({"__code": own.cast("int"), "__period": period(F.col("session_id"))})
    return scan.blocked(rows, _regime_automaton(states, dwell, max_flips), ["symbol"], block).drop("__code", "__period")


def period(session: Column) -> Column:
    """A session's mark as a double: 48 bits of its hash, so that neighbouring sessions differ."""
    return F.shiftrightunsigned(F.xxhash64(session), 16).cast("double")


def _averages(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("symbol", "bucket").orderBy("ts", "seq")
    averaged = by_halo(rows, halo=ATR_ROWS).withColumns(
        {
            "sma_fast": F.avg("close").over(order.rowsBetween(1 - FAST, 0)),
            "sma_slow": F.avg("close").over(order.rowsBetween(1 - SLOW, 0)),
            "__q": F.percentile("atr", F.array(F.lit(0.5), F.lit(0.75))).over(order.rowsBetween(1 - ATR_ROWS, 0)),
        }
    )
    return averaged.where(~F.col("in_halo")).drop("bucket", "in_halo")


def rule_based(rows: DataFrame) -> DataFrame:
    """rows (symbol, ts, seq, bar_no, close, atr) with rule_state, rule_confidence and rule_signal, from ATR quantiles and moving averages."""
    out = _averages(rows)
    strength = F.abs(F.col("sma_fast") - F.col("sma_slow")) / F.greatest("sma_slow", F.lit(1e-10))
    calm = (F.col("atr") < F.col("__q")[0]) & (strength < TREND)
    ready = F.col("bar_no") >= SLOW - 1
    out = out.withColumn("rule_state", F.when(~ready | calm, 0).when(F.col("atr") >= F.col("__q")[1], 2).otherwise(1))
    close, slow, fast = F.col("close"), F.col("sma_slow"), F.col("sma_fast")
    trend = F.when(fast > slow, 1).when(fast < slow, -1).otherwise(0)
    fade = F.when(close < slow * (1 - FADE), 1).when(close > slow * (1 + FADE), -1).otherwise(0)
    signal = F.when(~ready, 0).when(F.col("rule_state") == 1, trend).when(F.col("rule_state") == 2, fade).otherwise(0)
    return out.withColumns({"rule_signal": signal, "rule_confidence": F.lit(RULE_CONFIDENCE)}).drop("__q")


def signals(rows: DataFrame, labels: Column | None = None, k: int = 3) -> DataFrame:
    """rows (regime, log_return_z, rsi_deviation) with label and signal."""
    label = regime_label(F.col("regime"), k) if labels is None else F.try_element_at(labels, F.col("regime") + 1)
    out = rows.withColumn("label", label)
    return out.withColumn("signal", regime_signal(F.col("regime"), F.col("label"), F.col("log_return_z"), F.col("rsi_deviation")))


def source_priority(bars: DataFrame, external: DataFrame, scored: DataFrame, rules: DataFrame, stale_bars: int = 5) -> DataFrame:
    """bars (symbol, bar_no) with state, confidence and source: the external answer if at most `stale_bars` old, else the
    model's, else the rule's.

    external, scored, rules: (symbol, bar_no, state, confidence).
    """
    named = lambda df, n: df.select("symbol", "bar_no", F.struct("state", "confidence", F.lit(n).alias("source")).alias(n))
    aged = external.select("symbol", F.struct("state", "confidence", F.lit("external").alias("source")).alias("x"), F.col("bar_no").alias("from"), F.explode(F.sequence(F.col("bar_no"), F.col("bar_no") + stale_bars)).alias("bar_no"))
    fresh = aged.groupBy("symbol", "bar_no").agg(F.max_by("x", "from").alias("external"))
    joined = bars.join(fresh, ["symbol", "bar_no"], "left").join(named(scored, "model"), ["symbol", "bar_no"], "left").join(named(rules, "rule"), ["symbol", "bar_no"], "left")
    return joined.withColumn("__x", F.coalesce("external", "model", "rule")).select(*bars.columns, "__x.state", "__x.confidence", "__x.source")


def stops(rows: DataFrame, instruments: DataFrame) -> DataFrame:
    """rows (symbol, atr, regime) with stop_distance and target_distance: ATR by the profile's multiples and the regime's factors."""
    joined = rows.join(F.broadcast(instruments.select("symbol", "stop_atr_mult", "target_atr_mult", "point_value", "max_size")), "symbol")
    factor = lambda i: F.when(F.col("regime") == 0, STOP_FACTORS[0][i]).when(F.col("regime") == 2, STOP_FACTORS[2][i]).otherwise(1.0)
    return joined.withColumns({"stop_distance": F.col("atr") * F.col("stop_atr_mult") * factor(0), "target_distance": F.col("atr") * F.col("target_atr_mult") * factor(1)})


def sizes(rows: DataFrame, daily_max_loss: float = 1000.0, max_trades: int = 10, evaluation: bool = False) -> DataFrame:
    """stops() rows with size: what the risk of a trade buys, between 1 and the profile's largest; 1 in evaluation."""
    if evaluation:
        return rows.withColumn("size", F.lit(1).cast("int"))
    lot = F.col("stop_distance") * F.col("point_value")
    bought = F.when(lot > 0, F.floor(F.lit(daily_max_loss / max(max_trades, 1)) / lot)).otherwise(1)
    return rows.withColumn("size", F.greatest(F.lit(1), F.least(bought, F.col("max_size"))).cast("int"))


def flatten_due(ts: Column, session_end: Column, minutes: Column, in_position: Column) -> Column:
    """Whether a position must be closed: at most so many minutes are left of the session."""
    left = (session_end.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")) / 60
    return in_position & (minutes > 0) & (left <= minutes)


def decisions(rows: DataFrame, longs: bool = True, shorts: bool = True) -> DataFrame:
    """rows (bar_no, flatten, signal, confirmation, lock, can_enter) with gate, the first that blocks, and action (1, -1 or 0)."""
    gate = F.coalesce(
        F.when(F.col("bar_no") < 100, F.lit("warm_up")),
        F.when(F.coalesce(F.col("flatten"), F.lit(False)), F.lit("flatten")),
        F.when((F.col("signal") != 0) & (F.col("confirmation") == "deny"), F.lit("order_flow")),
        F.when(F.col("lock").isNotNull(), F.lit("evaluation_lock")),
        F.when(~F.coalesce(F.col("can_enter"), F.lit(True)), F.lit("risk_state")),
        F.when(F.col("signal") == 0, F.lit("no_signal")),
        F.when((F.col("signal") > 0) & F.lit(not longs), F.lit("side_disabled")),
        F.when((F.col("signal") < 0) & F.lit(not shorts), F.lit("side_disabled")),
    )
    return rows.withColumn("gate", gate).withColumn("action", F.when(F.col("gate").isNull(), F.col("signal")).otherwise(0))
