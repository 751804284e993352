"""Order flow: bars from ticks, trade sides from the prevailing quote, deltas, and the confirmation of a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.features import BUCKET, by_halo
from barwright.sources.bars import numbered

#: Fixed by the contract: sizes looked back on, how many are needed, and how many times the mean is large.
SIZES, LEAST_SIZES, LARGE = 200, 10, 3.0


def bars_from_ticks(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """OHLCV bars of the trades (kind L) by event time; ts is the bar's start, seq 0."""
    trades = ticks.where("kind = 'L'").withColumn("__at", F.struct("ts", "seq"))
    return (
        trades.groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("price", "__at").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "__at").alias("close"),
            F.sum("volume").cast("double").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("ts"), F.lit(0).cast("long").alias("seq"), "open", "high", "low", "close", "volume")
    )


def with_quotes(ticks: DataFrame, by_day: bool = True) -> DataFrame:
    """Trades with bid and ask: each the latest quote at or before the trade in the order of (ts, seq).

    An as-of join of a stream with itself. by_day works on (symbol, day), and carries each day's last quotes over to the days
    that follow through one row a day, so a symbol's whole history never meets in one task.
    """
    day = F.to_date("ts")
    quote = lambda kind: F.when(F.col("kind") == kind, F.col("price"))
    keys = ["symbol", "__day"] if by_day else ["symbol"]
    rows = ticks.withColumns({"__day": day, "__b": quote("B"), "__a": quote("A")})
    upto = Window.partitionBy(*keys).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"bid": F.last("__b", ignorenulls=True).over(upto), "ask": F.last("__a", ignorenulls=True).over(upto)})
    if by_day:
        at = F.struct("ts", "seq")
        days = rows.groupBy("symbol", "__day").agg(F.max_by("__b", F.when(F.col("__b").isNotNull(), at)).alias("b"), F.max_by("__a", F.when(F.col("__a").isNotNull(), at)).alias("a"))
        before = Window.partitionBy("symbol").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
        carried = days.select("symbol", "__day", F.last("b", ignorenulls=True).over(before).alias("__cb"), F.last("a", ignorenulls=True).over(before).alias("__ca"))
        rows = rows.join(carried, ["symbol", "__day"], "left").withColumns({"bid": F.coalesce("bid", "__cb"), "ask": F.coalesce("ask", "__ca")}).drop("__cb", "__ca")
    return rows.where("kind = 'L'").drop("__day", "__b", "__a")


def with_sides(trades: DataFrame) -> DataFrame:
    """Trades with buy_vol and sell_vol: at the ask or above bought, at the bid or below sold, else half each. Volume of 0 or less is left out."""
    half, volume = F.col("volume") / 2, F.col("volume")
    bought = F.col("ask").isNotNull() & (F.col("price") >= F.col("ask"))
    sold = F.col("bid").isNotNull() & (F.col("price") <= F.col("bid"))
    return trades.where("volume > 0").withColumns({"buy_vol": F.when(bought, volume).when(sold, 0.0).otherwise(half), "sell_vol": F.when(bought, 0.0).when(sold, volume).otherwise(half)})


def bar_flow(sided: DataFrame, width: str = "1 hour") -> DataFrame:
    """symbol, ts, buy_vol, sell_vol, delta, total, imbalance of each bar; works on a stream with a watermark too."""
    sums = sided.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.sum("buy_vol").alias("buy_vol"), F.sum("sell_vol").alias("sell_vol"))
    total, delta = F.col("buy_vol") + F.col("sell_vol"), F.col("buy_vol") - F.col("sell_vol")
    return sums.select("symbol", F.col("w.start").alias("ts"), "buy_vol", "sell_vol", delta.alias("delta"), total.alias("total"), F.when(total > 0, delta / total).otherwise(0.0).alias("imbalance"))


def cumulative_delta(flow: DataFrame, session: Column | None = None) -> DataFrame:
    """flow with session_id and cum_delta, which starts anew with each session (by default the UTC day)."""
    rows = flow.withColumn("session_id", F.to_date("ts") if session is None else session)
    running = Window.partitionBy("symbol", "session_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cum_delta", F.sum("delta").over(running))


def large_orders(trades: DataFrame, width: str = "1 hour") -> DataFrame:
    """symbol, ts, large_orders: at each bar's last trade, how many of the last 200 sizes reach three times their mean; 0 for fewer than 10."""
    sizes = numbered(trades.where("volume > 0").withColumn("w", F.window("ts", width).getField("start")))
    ends = F.max("bar_no").over(Window.partitionBy("symbol", "w")) == F.col("bar_no")
    rows = by_halo(sizes.withColumn("__ends", ends), halo=SIZES)
    frame = Window.partitionBy("symbol", "bucket").orderBy("ts", "seq").rowsBetween(1 - SIZES, 0)
    # The list of sizes is made for every row by the frame, but kept and counted only on a bar's last trade.
    rows = rows.withColumns({"__sizes": F.collect_list("volume").over(frame), "__mean": F.avg("volume").over(frame)}).where("__ends and not in_halo")
    n = F.size(F.filter("__sizes", lambda v: v >= LARGE * F.col("__mean")))
    return rows.select("symbol", F.col("w").alias("ts"), F.when(F.size("__sizes") >= LEAST_SIZES, n).otherwise(0).alias("large_orders"))


def bar_proxy(bars: DataFrame, flow: DataFrame | None = None) -> DataFrame:
    """bars with delta and imbalance: from ticks where `flow` has the bar, else from the close's place in the bar's range."""
    spread = F.col("high") - F.col("low")
    place = F.when(spread > 0, (F.col("close") - F.col("open")) / spread).otherwise(0.0)
    if flow is None:
        return bars.withColumns({"delta": place * F.col("volume"), "imbalance": place})
    known = flow.select("symbol", "ts", F.col("delta").alias("__d"), F.col("imbalance").alias("__i"))
    joined = bars.join(known, ["symbol", "ts"], "left")
    return joined.withColumns({"delta": F.coalesce("__d", place * F.col("volume")), "imbalance": F.coalesce("__i", place)}).drop("__d", "__i")


def delta_z(flow: DataFrame, lookback: int = 5, rows: int = BUCKET) -> DataFrame:
    """flow with delta_z: the mean of the last `lookback` deltas against mean and deviation of the last max(2 lookback, 50); and n_deltas.

    Works in buckets of `rows` bars that repeat those they look back on. flow has one row for each symbol and ts.
    """
    far = max(2 * lookback, 50)
    spread_out = by_halo(numbered(flow, order=("ts",)), rows, far)
    order = Window.partitionBy("symbol", "bucket").orderBy("bar_no")
    short, wide = order.rowsBetween(1 - lookback, 0), order.rowsBetween(1 - far, 0)
    spread = F.coalesce(F.stddev_samp("delta").over(wide), F.lit(0.0))
    z = (F.avg("delta").over(short) - F.avg("delta").over(wide)) / spread
    found = spread_out.withColumns({"delta_z": F.when(spread > 1e-10, z).otherwise(0.0), "n_deltas": (F.col("bar_no") + 1).cast("int")})
    return found.where("not in_halo").drop("bar_no", "bucket", "in_halo")


def confirmation(signal: Column, z: Column, imbalance: Column, n_deltas: Column, lookback: int = 5, delta_threshold: float = 1.5, imbalance_threshold: float = 0.15) -> Column:
    """'confirm', 'deny' or 'neutral' for a signal of 1 or -1, from the delta's z-score and the bar's imbalance."""
    along = signal.cast("double")
    delta_for, delta_against = z * along > delta_threshold, z * along < -delta_threshold
    volume_for, volume_against = imbalance * along > imbalance_threshold, imbalance * along < -imbalance_threshold
    idle = (signal == 0) | (n_deltas < max(lookback, 3))
    return F.when(idle, "neutral").when((delta_for & ~volume_against) | (volume_for & ~delta_against), "confirm").when(delta_against & volume_against, "deny").otherwise("neutral")
