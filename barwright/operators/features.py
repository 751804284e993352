"""The six features of a bar, and the rolling and smoothed series behind them.

Frames hold symbol, ts, seq, open, high, low, close, volume. Finite row frames are windows over (ts, seq). Wilder's smoothing is a
weighted running sum over stretches of bars, as windows too: what lies further back than a stretch weighs less than a
rounding error. A symbol with very many bars is cut into buckets that carry a halo of earlier rows, see `by_halo`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions import scalar as S
from barwright.sources.bars import numbered
from barwright.sources.schema import FEATURES, session_id

#: Fixed by the feature contract: windows of the z-scores, of realised volatility and of volume, and Wilder's period.
Z_WINDOW, VOL_WINDOW, VOLUME_WINDOW, PERIOD = 100, 20, 20, 14
WARM_UP = 100
#: Rows before a bar that its features depend on, recursions aside, and rows of a bucket.
HALO, BUCKET = Z_WINDOW + VOL_WINDOW, 65_536
#: Bars of a stretch of Wilder's smoothing: (13/14)^512 is 3e-17, so two stretches hold all of an average that a double can tell.
STRETCH = 512


def order(by: list[str]):
    return Window.partitionBy(*by).orderBy("ts", "seq")


def rolling_mean(x: Column, n: int, by: list[str]) -> Column:
    return F.avg(x).over(order(by).rowsBetween(1 - n, 0))


def rolling_std(x: Column, n: int, by: list[str]) -> Column:
    """Sample deviation of the last n rows, 0 for a single one."""
    return F.coalesce(F.stddev_samp(x).over(order(by).rowsBetween(1 - n, 0)), F.lit(0.0))


def z_score(x: Column, n: int, by: list[str]) -> Column:
    return (x - rolling_mean(x, n, by)) / F.greatest(rolling_std(x, n, by), F.lit(S.SMALL))


def by_halo(bars: DataFrame, rows: int = BUCKET, halo: int = HALO) -> DataFrame:
    """bars with `bucket` and `in_halo`: windows over (symbol, bucket) then see what windows over symbol see, `halo` rows back.

    Every bucket repeats the last `halo` rows before it; drop rows with in_halo once the windows are computed. A symbol with
    any number of bars so becomes many groups, and a short one stays a single group. Needs bar_no.
    """
    rows = max(rows, halo)
    home = F.floor(F.col("bar_no") / rows)
    copies = F.array(F.struct(home.alias("bucket"), F.lit(False).alias("in_halo")), F.struct((home + 1).alias("bucket"), F.lit(True).alias("in_halo")))
    near = F.pmod(F.col("bar_no"), F.lit(rows)) >= rows - halo
    spread = bars.withColumn("__copy", F.explode(F.when(near, copies).otherwise(F.slice(copies, 1, 1))))
    return spread.withColumns({"bucket": F.col("__copy.bucket"), "in_halo": F.col("__copy.in_halo")}).drop("__copy")


def _with_returns(bars: DataFrame, by: list[str]) -> DataFrame:
    previous = F.lag("close").over(order(by))
    # A bucket's first row may be a copy in the middle of the series: its own return is never used beyond the halo.
    return bars.withColumn("log_return", S.log_return(F.col("close"), previous))


def window_features(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with log_return, log_return_z, realised_vol_z and volume_z: pure window expressions."""
    by = list(by)
    out = _with_returns(bars, by)
    out = out.withColumn("realised_vol", rolling_std(F.col("log_return"), VOL_WINDOW, by))
    first = F.row_number().over(order(by)) == 1
    volume = S.clip(z_score(F.col("volume"), VOLUME_WINDOW, by), -3, 3)
    return out.withColumns(
        {
            "log_return_z": S.finite(z_score(F.col("log_return"), Z_WINDOW, by)),
            "realised_vol_z": S.finite(z_score(F.col("realised_vol"), Z_WINDOW, by)),
            "volume_z": F.when(first, 0.0).otherwise(S.finite(volume)),
        }
    )


def session_vwap(bars: DataFrame) -> DataFrame:
    """bars with vwap: volume-weighted typical price since the session began (needs session_id)."""
    running = Window.partitionBy("symbol", "session_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    price = S.typical_price(F.col("high"), F.col("low"), F.col("close"))
    return bars.withColumn("vwap", F.sum(price * F.col("volume")).over(running) / F.greatest(F.sum("volume").over(running), F.lit(S.SMALL)))


def endless_vwap(bars: DataFrame, rows: int = BUCKET) -> DataFrame:
    """bars (with bar_no) with vwap since the series began: running sums within buckets, and the buckets' totals summed up before them."""
    worth = S.typical_price(F.col("high"), F.col("low"), F.col("close")) * F.col("volume")
    cut = bars.withColumn("__bucket", F.floor(F.col("bar_no") / rows))
    totals = cut.groupBy("symbol", "__bucket").agg(F.sum(worth).alias("pv"), F.sum("volume").alias("v"))
    before = Window.partitionBy("symbol").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("symbol", "__bucket", F.coalesce(F.sum("pv").over(before), F.lit(0.0)).alias("__pv"), F.coalesce(F.sum("v").over(before), F.lit(0.0)).alias("__v"))
    running = Window.partitionBy("symbol", "__bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(carried, ["symbol", "__bucket"])
    vwap = (F.col("__pv") + F.sum(worth).over(running)) / F.greatest(F.col("__v") + F.sum("volume").over(running), F.lit(S.SMALL))
    return joined.withColumn("vwap", vwap).drop("__bucket", "__pv", "__v")


_AVERAGED = ("gain", "loss", "tr")


def wilder_averages(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars (with bar_no) with rsi and atr, from windows over `by`, whose rows may begin with a halo of whole stretches.

    An average is the sum of what entered it times (13/14)^age. In a stretch that is a running sum of entries weighed by
    (14/13)^place, scaled back; all entries are positive, so nothing cancels. The stretch before adds its last value, decayed.
    Where nothing has moved for a stretch and more, RSI tells by the rows in sight whether there ever was a gain.
    """
    window, n = order(list(by)), F.col("bar_no")
    previous = F.lag("close").over(window)
    change = F.coalesce(F.col("close") - previous, F.lit(0.0))
    rows = bars.withColumns({"tr": S.true_range(F.col("high"), F.col("low"), previous), "gain": S.gain(change), "loss": S.loss(change)})
    seeds = {"gain": PERIOD, "loss": PERIOD, "tr": PERIOD - 1}
    means = {c: F.avg(c).over(window.rowsBetween(1 - PERIOD, 0)) for c in _AVERAGED}
    rows = rows.withColumns({f"__in_{c}": F.when(n > seeds[c], F.col(c) / PERIOD).when(n == seeds[c], means[c]).otherwise(0.0) for c in _AVERAGED})
    place, keep = F.pmod(n, F.lit(STRETCH)).cast("double"), (PERIOD - 1) / PERIOD
    rows = rows.withColumn("__stretch", F.floor(n / STRETCH))
    within = Window.partitionBy(*by, "__stretch").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__own_{c}": F.sum(F.col(f"__in_{c}") * F.pow(F.lit(1 / keep), place)).over(within) * F.pow(F.lit(keep), place) for c in _AVERAGED})
    # The order by stretch first lets both windows share one sort.
    past = Window.partitionBy(*by).orderBy("__stretch", "ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    carried = {c: F.coalesce(F.last(F.when(place == STRETCH - 1, F.col(f"__own_{c}")), ignorenulls=True).over(past), F.lit(0.0)) for c in _AVERAGED}
    rows = rows.withColumns({f"__avg_{c}": F.col(f"__own_{c}") + carried[c] * F.pow(F.lit(keep), place + 1) for c in _AVERAGED})
    rows = rows.withColumn("__ever_up", F.max("gain").over(past.rowsBetween(Window.unboundedPreceding, 0)) > 0)
    up, down = F.col("__avg_gain"), F.col("__avg_loss")
    # A plain recursion's average stays above 0 once there was a gain, however long ago.
    flat = F.when(F.col("__ever_up"), 100.0).otherwise(50.0)
    rsi = F.when(n < PERIOD, 50.0).when(down < S.SMALL, flat).otherwise(100 - 100 / (1 + up / down))
    atr = F.when(n < PERIOD - 1, F.col("tr")).otherwise(F.col("__avg_tr"))
    own = [f"__{x}_{c}" for x in ("in", "own", "avg") for c in _AVERAGED]
    return rows.withColumns({"rsi": rsi, "atr": atr}).drop("tr", "gain", "loss", "__stretch", "__ever_up", *own)


def _whole_stretches(rows: int) -> int:
    return -(-max(rows, 1) // STRETCH) * STRETCH


def wilder(bars: DataFrame, halo_rows: int = BUCKET) -> DataFrame:
    """bars (with bar_no) with rsi and atr, Wilder's smoothing over 14 bars.

    RSI is 50 until 14 changes are known; then average gains and losses start from their means. ATR is the true range until 14
    are known. Buckets of `halo_rows` bars (rounded up to whole stretches) repeat the stretch before them.
    """
    cut = by_halo(bars, _whole_stretches(halo_rows), STRETCH)
    return wilder_averages(cut, ("symbol", "bucket")).where(~F.col("in_halo")).drop("bucket", "in_halo")


def features(bars: DataFrame, session: str | None = "UTC", session_start: str = "00:00", contract_edges: bool = False, halo_rows: int = BUCKET) -> DataFrame:
    """bars with bar_no, session_id, rsi, atr, vwap, the six features, `features` (their array) and `ready`.

    session: time zone whose days, from session_start on, reset the VWAP; None never resets it. contract_edges: on a bar
    without volume the close stands for the VWAP and the volume feature is 0. Row windows see buckets of `halo_rows` bars
    (rounded up to whole stretches), so no task holds a whole long series. Values that are not finite become 0.
    """
    rows = numbered(bars)
    rows = rows.withColumn("session_id", session_id(F.col("ts"), session, session_start) if session else F.lit("1970-01-01").cast("date"))
    cut = ("symbol", "bucket")
    rows = by_halo(rows, _whole_stretches(halo_rows), STRETCH)
    rows = wilder_averages(window_features(rows, cut), cut).where(~F.col("in_halo")).drop("bucket", "in_halo")
    rows = rows.withColumn("volume_z", F.when(F.col("bar_no") == 0, 0.0).otherwise(F.col("volume_z")))
    rows = session_vwap(rows) if session else endless_vwap(rows)
    empty = F.col("volume") <= 0
    vwap = F.when(empty, F.col("close")).otherwise(F.col("vwap")) if contract_edges else F.col("vwap")
    atr = S.denominator(F.col("atr"))
    rows = rows.withColumns(
        {
            "rsi_deviation": S.finite((F.col("rsi") - 50) / 50),
            "vwap_distance": S.finite(S.clip((F.col("close") - vwap) / atr, -3, 3)),
            "range_ratio": S.finite(S.clip((F.col("high") - F.col("low")) / atr, 0, 5)),
        }
    )
    if contract_edges:
        rows = rows.withColumn("volume_z", F.when(empty, 0.0).otherwise(F.col("volume_z")))
    return rows.withColumns({"features": F.array(*FEATURES), "ready": F.col("bar_no") >= WARM_UP - 1})


def parity(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """feature, worst, within: the largest difference of each feature between two tables joined on (symbol, ts, seq)."""
    joined = left.select("symbol", "ts", "seq", F.struct(*FEATURES).alias("l")).join(right.select("symbol", "ts", "seq", F.struct(*FEATURES).alias("r")), ["symbol", "ts", "seq"])
    worst = joined.agg(*(F.max(F.abs(F.col(f"l.{f}") - F.col(f"r.{f}"))).alias(f) for f in FEATURES))
    rows = worst.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f), F.lit(0.0)).alias("worst")) for f in FEATURES))).alias("x"))
    return rows.select("x.feature", "x.worst", (F.col("x.worst") <= tolerance).alias("within"))


def trainable(featured: DataFrame, warm_up: int = WARM_UP) -> DataFrame:
    """Rows after the warm-up whose features are all numbers."""
    good = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x))
    return featured.where((F.col("bar_no") >= warm_up) & good)
