"""Data-quality checks on bars: counts of what is wrong, per symbol and check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.features import by_halo, trainable
from barwright.sources.bars import numbered

#: Fixed limits: bars of a usable series, times the median interval that make a gap, deviations that make an outlier.
LEAST_BARS, GAP_FACTOR, SIGMAS, LEAST_RETURNS, LEAST_TRAINING = 200, 3.0, 10.0, 20, 500


def _checks(n: str = "n_bars") -> dict[str, Column]:
    """Counts from the aggregates of quality_counts()."""
    return {
        "few_bars": F.when(F.col(n) < LEAST_BARS, F.col(n)).otherwise(0),
        "duplicate_timestamps": F.col("n_ts") - F.col("n_distinct_ts"),
        "high_below_low": F.col("high_below_low"),
        "open_above_high": F.col("open_above_high"),
        "open_below_low": F.col("open_below_low"),
        "time_gaps": F.col("time_gaps"),
        "return_outliers": F.col("return_outliers"),
        "close_not_positive": F.col("close_not_positive"),
    }


def with_steps(bars: DataFrame) -> DataFrame:
    """Clean bars with `gap` (seconds since the bar before) and `ret` (log return; null where a price is not positive)."""
    bars = by_halo(numbered(bars), halo=1)
    order = Window.partitionBy("symbol", "bucket").orderBy("ts", "seq")
    before = F.lag(F.struct("ts", "close")).over(order)
    gap = F.col("ts").cast("timestamp").cast("double") - before["ts"].cast("timestamp").cast("double")
    ratio = F.when((F.col("close") > 0) & (before["close"] > 0), F.log(F.col("close") / before["close"]))
    return bars.withColumns({"gap": gap, "ret": ratio}).where(~F.col("in_halo")).drop("bucket", "in_halo", "bar_no")


def quality_counts(bars: DataFrame) -> DataFrame:
    """symbol, n_bars and one column for each check. Thresholds come from one aggregate, joined back as one row a symbol."""
    rows = with_steps(bars)
    limits = rows.groupBy("symbol").agg(F.percentile("gap", 0.5).alias("__median"), F.avg("ret").alias("__mean"), F.stddev_samp("ret").alias("__std"), F.count("*").alias("__n"))
    joined = rows.join(limits, "symbol")
    gap = (F.col("__median") > 0) & (F.col("gap") > GAP_FACTOR * F.col("__median"))
    far = (F.col("__n") > LEAST_RETURNS) & (F.col("__std") > 0) & (F.abs(F.col("ret") - F.col("__mean")) > SIGMAS * F.col("__std"))
    return joined.groupBy("symbol").agg(
        F.count("*").alias("n_bars"),
        F.count("ts").alias("n_ts"),
        F.count_distinct("ts").alias("n_distinct_ts"),
        F.count_if(F.col("high") < F.col("low")).alias("high_below_low"),
        F.count_if(F.col("open") > F.col("high")).alias("open_above_high"),
        F.count_if(F.col("open") < F.col("low")).alias("open_below_low"),
        F.count_if(gap).alias("time_gaps"),
        F.count_if(far).alias("return_outliers"),
        F.count_if(F.col("close") <= 0).alias("close_not_positive"),
    )


def quality(bars: DataFrame) -> DataFrame:
    """symbol, check, n: one row for each check that finds something."""
    counts = quality_counts(bars)
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("check"), n.cast("long").alias("n")) for name, n in _checks().items())))
    return counts.select("symbol", rows.alias("x")).select("symbol", "x.check", "x.n").where("n > 0")


def report(bars: DataFrame) -> DataFrame:
    """symbol, n_bars, clean, issues: clean where no check finds anything."""
    counts = quality_counts(bars)
    issues = F.array_compact(F.array(*(F.when(n > 0, F.lit(name)) for name, n in _checks().items())))
    return counts.select("symbol", "n_bars", (F.size(issues) == 0).alias("clean"), issues.alias("issues"))


def training_status(bars: DataFrame, featured: DataFrame, least: int = LEAST_TRAINING) -> DataFrame:
    """symbol, n_bars, n_trainable, status: whether a symbol has bars enough before and after the warm-up."""
    after = trainable(featured).groupBy("symbol").agg(F.count("*").alias("n_trainable"))
    joined = bars.groupBy("symbol").agg(F.count("*").alias("n_bars")).join(after, "symbol", "left").fillna(0, ["n_trainable"])
    enough = F.when(F.col("n_bars") < least, "too_few_bars").when(F.col("n_trainable") < least, "too_few_after_warm_up").otherwise("ok")
    return joined.withColumn("status", enough)
