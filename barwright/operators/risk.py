"""Fills, daily P&L and risk states reconstructed from history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.plans import scan
from barwright.sources.bars import numbered
from barwright.sources.schema import session_id


def paired_fills(fills: DataFrame, instruments: DataFrame) -> DataFrame:
    """Exits with pnl: against the entry before them if no other exit came since, else 0. side is 1 or -1 on entries."""
    order = Window.partitionBy("account", "symbol").orderBy("ts", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    entry = F.when(F.col("is_entry"), F.struct("price", "side"))
    rows = fills.withColumns({"__entry": F.last(entry, ignorenulls=True).over(before), "__after_exit": ~F.lag("is_entry", 1, False).over(order)})
    points = F.broadcast(instruments.select("symbol", "point_value"))
    exits = rows.where("not is_entry").join(points, "symbol", "left").withColumn("__point", F.coalesce("point_value", F.lit(1.0)))
    pnl = (F.col("price") - F.col("__entry.price")) * F.col("__entry.side") * F.col("qty") * F.col("__point")
    return exits.withColumn("pnl", F.when(F.col("__after_exit"), 0.0).otherwise(F.coalesce(pnl, F.lit(0.0)))).drop("__entry", "__after_exit", "__point", "point_value")


def daily(trades: DataFrame, order: tuple[str, ...] = ("ts", "trade_id")) -> DataFrame:
    """trades (account, ts, pnl, ...) with day, day_pnl, day_trades and losses (the current run of them), all anew each day."""
    rows = trades.withColumn("day", F.to_date("ts"))
    upto = Window.partitionBy("account", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"day_pnl": F.sum("pnl").over(upto), "day_trades": F.count("*").over(upto), "__island": F.sum(F.when(F.col("pnl") < 0, 0).otherwise(1)).over(upto)})
    run = Window.partitionBy("account", "day", "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("losses", F.sum(F.when(F.col("pnl") < 0, 1).otherwise(0)).over(run)).drop("__island")


def risk_state(rows: DataFrame, max_loss: float = 1000.0, profit_lock: float = 1500.0, max_trades: int = 10, max_losses: int = 3) -> DataFrame:
    """daily() rows with risk_state after each exit: locked by loss, by profit or by a run of losses, halted by trades, or idle."""
    state = F.when(F.col("day_pnl") <= -max_loss, "locked_loss")
    if profit_lock > 0:
        state = state.when(F.col("day_pnl") >= profit_lock, "locked_profit")
    state = state.when(F.col("losses") >= max_losses, "locked_streak").when(F.col("day_trades") >= max_trades, "halted").otherwise("idle")
    return rows.withColumn("risk_state", state)


#: Live states in the order of the automaton, and the codes of events; an exit's code tells whether it breaks a limit.
LIVE = ("idle", "armed", "in_trade", "locked", "halted", "emergency_stop")
EVENTS = ("signal", "entry", "exit", "stop", "clear")
_SIGNAL, _ENTRY, _EXIT, _STOP, _CLEAR, _BREACH, _OTHER = range(7)


def _risk_automaton(max_trades: int) -> scan.Automaton:
    """The live state and the day's entries, counted up to max_trades; a new day sets both back but for an emergency stop."""
    idle, armed, in_trade, locked, halted, stopped = range(6)
    number = lambda live, trades: live * (max_trades + 1) + trades

    def step(live: int, trades: int, code: int) -> int:
        if code == _STOP:
            live = stopped
        elif code == _CLEAR:
            live = idle
        elif live == stopped:
            pass
        elif code == _BREACH:
            live = locked
        elif code == _EXIT:
            live = halted if trades >= max_trades else idle
        elif code == _SIGNAL and live == idle:
            live = armed
        elif code == _ENTRY and live in (idle, armed):
            live, trades = in_trade, min(trades + 1, max_trades)
        return number(live, trades)

    everything = [(live, trades) for live in range(6) for trades in range(max_trades + 1)]
    return scan.Automaton(
        start=[0.0, float("nan")],
        columns={"__live": "int", "day_trades": "int"},
        table=tuple(tuple(step(live, trades, code) for code in range(7)) for live, trades in everything),
        reset=tuple(number(live, trades) if live == stopped else 0 for live, trades in everything),
        read=(tuple(live for live, _ in everything), tuple(trades for _, trades in everything)),
    )


def _risk_days(events: DataFrame, session: str, session_start: str) -> DataFrame:
    """events with `day` and `__epoch`: days that an emergency stop joins are one epoch, any other day begins its own.

    Stops and clears alone tell where a stop holds: the last of them on each day, carried on over the days, one row a day.
    """
    rows = events.withColumn("day", session_id(F.col("ts"), session, session_start))
    held = F.max_by("kind", F.when(F.col("kind").isin("stop", "clear"), F.struct("ts", "seq")))
    days = rows.groupBy("account", "day").agg(F.when(F.count_if(F.col("kind").isin("stop", "clear")) > 0, held).alias("__held"))
    earlier = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__new", F.coalesce(F.last("__held", ignorenulls=True).over(earlier) != "stop", F.lit(True)))
    upto = Window.partitionBy("account").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(days.select("account", "day", F.sum(F.col("__new").cast("int")).over(upto).alias("__epoch")), ["account", "day"])


def live_state(events: DataFrame, max_loss: float = 1000.0, profit_lock: float = 1500.0, max_trades: int = 10, max_losses: int = 3, block: int = scan.BLOCK, session: str = "UTC", session_start: str = "00:00") -> DataFrame:
    """events (account, ts, seq, kind: signal, entry, exit, stop or clear; pnl of exits) with live_state, day_pnl, day_trades, losses and can_enter.

    A signal arms an idle account, an entry counts only from idle or armed, an exit adds its P&L and locks, halts or frees the
    account whatever it was. Each day (from session_start in the time zone `session`) begins anew, but an emergency stop stays, with its day's sums, until it is cleared; then
    the account is idle. day_trades counts up to max_trades. Other kinds change nothing, a null pnl is 0.
    """
    rows = _risk_days(events.withColumn("__pnl", F.when(F.col("kind") == "exit", F.coalesce("pnl", F.lit(0.0)))), session, session_start)
    by = ["account", "__epoch"]
    upto = Window.partitionBy(*by).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"day_pnl": F.coalesce(F.sum("__pnl").over(upto), F.lit(0.0)), "__island": F.count_if(F.col("__pnl") >= 0).over(upto)})
    run = Window.partitionBy(*by, "__island").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("losses", F.count_if(F.col("__pnl") < 0).over(run))
    breach = (F.col("day_pnl") <= -max_loss) | (F.col("losses") >= max_losses)
    if profit_lock > 0:
        breach |= F.col("day_pnl") >= profit_lock
    code = F.when((F.col("kind") == "exit") & breach, _BREACH)
    for i, kind in enumerate(EVENTS):
        code = code.when(F.col("kind") == kind, i)
    rows = rows.withColumns({"__code": code.otherwise(_OTHER), "__period": F.col("__epoch").cast("double")})
    found = scan.blocked(numbered(rows, "account"), _risk_automaton(max_trades), ["account"], block)
    found = found.withColumn("live_state", F.element_at(F.array(*(F.lit(x) for x in LIVE)), F.col("__live") + 1))
    return found.drop("__pnl", "__epoch", "__island", "__code", "__period", "__live", "bar_no").withColumn("can_enter", F.col("live_state").isin("idle", "armed"))


#: evaluation() sums whole millionths, as which amounts in cents add up exactly (to 9 x 10^9): what reaches a limit does not hang on the order of adding.
UNITS = 1e6


def evaluation(trades: DataFrame, trailing_limit: float = 2500.0, daily_limit: float = 1000.0, target: float = 3000.0, order: tuple[str, ...] = ("ts", "trade_id"), block: int = scan.BLOCK) -> DataFrame:
    """trades with day, cum_pnl, peak (from 0), trailing_dd, day_pnl, lock, progress and target_reached.

    The trailing limit locks for good; the daily limit locks until the day ends. An account's trades are cut into blocks, which
    hand on their sum, peak and whether the limit was reached, one row a block; no window holds a whole account. P&L counts in
    millionths, to which it is rounded: a sum that equals a limit reaches it.
    """
    trailing_limit, daily_limit, target = (float(round(x * UNITS)) for x in (trailing_limit, daily_limit, target))
    trades = trades.withColumns({"__given": F.col("pnl"), "pnl": F.rint(F.col("pnl") * UNITS)})
    today = Window.partitionBy("account", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("day", F.to_date("ts")).withColumn("day_pnl", F.sum("pnl").over(today))
    by_day = F.max((F.col("day_pnl") <= -daily_limit).cast("int")).over(today) == 1
    rows, carried = curve_blocks(rows.withColumn("__daily", by_day), order, block)
    series = Window.partitionBy("account").orderBy("__block")
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.withColumn("__peak", F.greatest(F.lit(0.0), F.coalesce(F.max(F.col("__start") + F.col("__high")).over(earlier), F.lit(0.0))))
    fall = F.greatest("__fall", F.col("__peak") - F.col("__start") - F.col("__low"))
    carried = carried.withColumn("__hit", F.coalesce(F.max((fall >= trailing_limit).cast("int")).over(earlier), F.lit(0)))
    rows = rows.join(carried.select("account", "__block", "__start", "__peak", "__hit"), ["account", "__block"])
    rows = rows.withColumns({"cum_pnl": F.col("__start") + F.col("__sum"), "peak": F.greatest("__peak", F.col("__start") + F.col("__top"))})
    rows = rows.withColumn("trailing_dd", F.col("peak") - F.col("cum_pnl"))
    upto = Window.partitionBy("account", "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    trailing = (F.col("__hit") == 1) | (F.max((F.col("trailing_dd") >= trailing_limit).cast("int")).over(upto) == 1)
    rows = rows.withColumn("lock", F.when(trailing, "trailing").when(F.col("__daily"), "daily"))
    progress = F.least(F.col("cum_pnl") / target, F.lit(1.0)) if target > 0 else F.lit(0.0)
    rows = rows.withColumns({"progress": progress, "target_reached": F.lit(target > 0) & (F.col("cum_pnl") >= target)})
    rows = rows.withColumns({"pnl": F.col("__given")} | {c: F.col(c) / UNITS for c in ("cum_pnl", "peak", "trailing_dd", "day_pnl")})
    return rows.drop("__block", "__at", "__start", "__peak", "__hit", "__sum", "__top", "__daily", "__given")


def curve_blocks(trades: DataFrame, order: tuple[str, ...], block: int) -> tuple[DataFrame, DataFrame]:
    """(trades, blocks): trades with __block, __at (their number), __sum and __top (sum of pnl within the block, and its highest so
    far); and for each block the sum before it (__start), and within it the highest and lowest sum and the largest fall."""
    rows = numbered(trades, "account", order).withColumnRenamed("bar_no", "__at").withColumn("__block", F.floor(F.col("__at") / block).cast("long"))
    upto = Window.partitionBy("account", "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum("pnl").over(upto)).withColumn("__top", F.max("__sum").over(upto))
    sums = rows.groupBy("account", "__block").agg(
        F.max_by("__sum", "__at").alias("__total"), F.max("__sum").alias("__high"), F.min("__sum").alias("__low"), F.max(F.col("__top") - F.col("__sum")).alias("__fall")
    )
    # One row a block: the number of blocks, not of trades, bounds this window.
    earlier = Window.partitionBy("account").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sums.withColumn("__start", F.coalesce(F.sum("__total").over(earlier), F.lit(0.0))).drop("__total")


def drawdowns(trades: DataFrame, order: tuple[str, ...] = ("ts", "trade_id"), block: int = scan.BLOCK) -> DataFrame:
    """account, max_dd: the largest fall of the running P&L below an earlier value, by blocks of each account's trades."""
    _, blocks = curve_blocks(trades, order, block)
    earlier = Window.partitionBy("account").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.col("__start") + F.col("__high")).over(earlier)
    falls = blocks.withColumn("__dd", F.greatest("__fall", before - F.col("__start") - F.col("__low")))
    return falls.groupBy("account").agg(F.max("__dd").alias("max_dd"))


def streaks(trades: DataFrame, order: tuple[str, ...] = ("ts", "trade_id"), block: int = scan.BLOCK) -> DataFrame:
    """account, max_losses: the longest run of losses. Runs are told apart by the trades before them that are no losses, counted by
    blocks, so a run may go through any number of blocks."""
    rows = numbered(trades, "account", order).withColumn("__block", F.floor(F.col("bar_no") / block).cast("long"))
    upto = Window.partitionBy("account", "__block").orderBy("bar_no").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.when(F.col("pnl") < 0, 0).otherwise(1)
    earlier = Window.partitionBy("account").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("account", "__block").agg(F.sum(ends).alias("__n")).select("account", "__block", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    runs = rows.withColumn("__run", F.sum(ends).over(upto)).join(blocks, ["account", "__block"]).groupBy("account", (F.col("__before") + F.col("__run")).alias("__run"))
    return runs.agg(F.count_if(F.col("pnl") < 0).alias("__n")).groupBy("account").agg(F.max("__n").alias("max_losses"))
