"""Column functions on prices, features and probability vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed by the feature contract.
SMALL = 1e-10
VARIANCE_FLOOR = 1e-6
#: Regime names by number of states; other numbers of states have no names of their own.
LABELS = {2: ("low_vol", "high_vol"), 3: ("low_vol", "trending", "high_vol")}


def log_return(close: Column, previous: Column) -> Column:
    """ln(close / previous); 0 on a first bar or after a price that is not positive."""
    return F.coalesce(F.when(previous > 0, F.log(close / previous)), F.lit(0.0))


def true_range(high: Column, low: Column, previous: Column) -> Column:
    return F.when(previous.isNull(), high - low).otherwise(F.greatest(high - low, F.abs(high - previous), F.abs(low - previous)))


def typical_price(high: Column, low: Column, close: Column) -> Column:
    return (high + low + close) / 3


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def finite(x: Column) -> Column:
    """Null, NaN and infinities as 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def denominator(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(SMALL))


def gain(change: Column) -> Column:
    return F.greatest(change, F.lit(0.0))


def loss(change: Column) -> Column:
    return F.greatest(-change, F.lit(0.0))


def log_gaussian(xs: list[Column], means: list[Column], variances: list[Column]) -> Column:
    """Log density of a diagonal Gaussian, unrolled over the features so that it stays in generated code."""
    total = F.lit(-0.5 * len(xs) * math.log(2 * math.pi))
    for x, mean, variance in zip(xs, means, variances, strict=True):
        v = F.greatest(variance, F.lit(VARIANCE_FLOOR))
        total = total - F.lit(0.5) * (F.log(v) + (x - mean) * (x - mean) / v)
    return total


def argmax(vector: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def regime_label(state: Column, k: Column | int) -> Column:
    """Name of a state; state_<i> where k has no names."""
    named = F.lit(None).cast("string")
    for count, labels in LABELS.items():
        own = F.array(*(F.lit(x) for x in labels))
        hit = (F.lit(k) if isinstance(k, int) else k) == count
        named = F.coalesce(named, F.when(hit & state.between(0, count - 1), F.element_at(own, (state + 1).cast("int"))))
    return F.coalesce(named, F.concat(F.lit("state_"), state.cast("string")))


def rounded(vector: Column, places: int = 6) -> Column:
    return F.transform(vector, lambda x: F.round(x, places))


def regime_signal(regime: Column, label: Column, return_z: Column, rsi_deviation: Column, trend: float = 0.5, fade: float = 0.4) -> Column:
    """1, -1 or 0: none in low volatility, with the return when trending, against the RSI in high volatility."""
    quiet = (regime < 0) | (F.coalesce(label, F.lit("")) == "low_vol") | (regime == 0)
    trending = (F.coalesce(label, F.lit("")) == "trending") | (regime == 1)
    wild = (F.coalesce(label, F.lit("")) == "high_vol") | (regime == 2)
    sign = lambda x, y, bound: F.when(x > bound, 1).when(y > bound, -1).otherwise(0)
    return F.when(quiet, 0).when(trending, sign(return_z, -return_z, trend)).when(wild, sign(-rsi_deviation, rsi_deviation, fade)).otherwise(0)
