"""Schemas of the domain frames, and the instrument dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "symbol string, ts timestamp, seq bigint, open double, high double, low double, close double, volume double"
TICKS = "symbol string, ts timestamp, seq bigint, kind string, price double, volume double"
TRADES = "account string, trade_id bigint, ts timestamp, pnl double"
FILLS = "account string, symbol string, ts timestamp, seq bigint, side int, qty int, price double, is_entry boolean"
METADATA = "trained_at string, training_bars bigint, log_likelihood double, converged boolean, n_iterations int, random_restarts int, data_start string, data_end string"
MODEL = (
    "schema_version int, symbol string, k int, n_features int, initial_probs array<double>, transition_matrix array<array<double>>, means array<array<double>>, "
    f"variances array<array<double>>, feature_mean array<double>, feature_std array<double>, regime_labels array<string>, metadata struct<{', '.join(x.replace(' ', ': ', 1) for x in METADATA.split(', '))}>"
)
REQUEST = "type string, symbol string, timestamp string, features array<double>"
FEATURES = ["log_return_z", "realised_vol_z", "rsi_deviation", "vwap_distance", "range_ratio", "volume_z"]

#: Fixed values of the instrument profiles. Columns: symbol, k, confidence, dwell bars, flips, stop and target in ATR, minutes
#: before the close, largest size, tick size, value of a point, session start and end, time zone.
PROFILES = [
    ("NQ", 3, 0.55, 3, 6, 2.0, 3.0, 5, 2, 0.25, 20.0, "18:00", "17:00", "America/Chicago"),
    ("ES", 3, 0.55, 3, 6, 2.0, 3.0, 5, 4, 0.25, 50.0, "18:00", "17:00", "America/Chicago"),
    ("CL", 3, 0.60, 4, 5, 1.5, 2.5, 10, 2, 0.01, 1000.0, "18:00", "17:00", "America/New_York"),
    ("NG", 3, 0.60, 4, 4, 1.5, 2.5, 10, 1, 0.001, 10000.0, "18:00", "17:00", "America/New_York"),
    ("GC", 3, 0.55, 3, 5, 2.0, 3.0, 10, 2, 0.10, 100.0, "18:00", "17:00", "America/New_York"),
    ("SI", 3, 0.60, 4, 4, 1.5, 2.5, 10, 1, 0.005, 5000.0, "18:00", "17:00", "America/New_York"),
    ("ZB", 3, 0.55, 3, 5, 2.0, 3.0, 5, 2, 0.03125, 1000.0, "18:00", "17:00", "America/Chicago"),
    ("UB", 3, 0.55, 3, 5, 2.0, 3.0, 5, 2, 0.03125, 1000.0, "18:00", "17:00", "America/Chicago"),
]
PROFILE = (
    "symbol string, k int, confidence_threshold double, dwell_bars int, max_flips int, stop_atr_mult double, target_atr_mult double, flatten_minutes int, "
    "max_size int, tick_size double, point_value double, session_start string, session_end string, timezone string"
)
SYMBOLS = [row[0] for row in PROFILES]


def instruments(spark: SparkSession, mode: str | None = None) -> DataFrame:
    """The instrument dimension: eight rows, with `priority` in the order of matching. mode: 'evaluation' or 'aggressive' overrides thresholds."""
    rows = spark.createDataFrame([(*row, i) for i, row in enumerate(PROFILES)], f"{PROFILE}, priority int")
    return with_mode(rows, mode) if mode else rows


def with_mode(profiles: DataFrame, mode: str) -> DataFrame:
    """Threshold overrides of a trading mode."""
    confidence, flips, minutes = F.col("confidence_threshold"), F.col("max_flips"), F.col("flatten_minutes")
    if mode == "evaluation":
        changes = {"confidence_threshold": F.greatest(confidence, F.lit(0.60)), "max_flips": F.least(flips, F.lit(4)), "flatten_minutes": F.greatest(minutes, F.lit(15))}
    elif mode == "aggressive":
        changes = {"confidence_threshold": F.greatest(confidence - 0.10, F.lit(0.40)), "max_flips": F.floor(flips * 1.5).cast("int")}
    else:
        raise ValueError(f"no such mode: {mode}")
    return profiles.withColumns(changes)


def session_id(ts: Column, zone: Column | str = "UTC", start: Column | str = "00:00") -> Column:
    """The date of the session a bar belongs to: sessions begin at `start` in the instrument's own time zone."""
    local = F.from_utc_timestamp(ts, zone)
    begin = F.lit(start) if isinstance(start, str) else start
    minutes = F.split(begin, ":")
    offset = F.make_dt_interval(F.lit(0), minutes[0].cast("int"), minutes[1].cast("int"))
    return F.to_date(local - offset)


def match_profile(frame: DataFrame, profiles: DataFrame, name: str = "instrument", override: str | None = None) -> DataFrame:
    """frame with `profile`: the first symbol, in the dimension's order, that the upper-cased name contains; an explicit override wins.

    The dimension becomes one array, joined as a single broadcast row: however many profiles there are, each name is looked through once.
    """
    listed = profiles.agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", "symbol"))), lambda p: p["symbol"]).alias("__known"))
    found = F.try_element_at(F.filter("__known", lambda s: F.contains(F.upper(F.col(name)), s)), F.lit(1))
    if override:
        found = F.coalesce(F.when(F.array_contains("__known", F.col(override)), F.col(override)), found)
    return frame.crossJoin(F.broadcast(listed)).withColumn("profile", found).drop("__known")
