import numpy as np
import pytest
from helpers import START, bars, sequential_features, walk
from pyspark.sql import functions as F

from barwright.operators import features as P
from barwright.sources.bars import numbered
from barwright.sources.schema import FEATURES


def table(df):
    return np.array([[r[f] for f in FEATURES] for r in df.orderBy("symbol", "bar_no").select(*FEATURES).collect()])


@pytest.mark.parametrize("n", [1, 13, 15, 320, 1400])
def test_features_equal_the_sequential_ones(spark, n):
    rows = walk(n)
    found = table(P.features(bars(spark, rows)))
    assert np.abs(found - sequential_features(rows)).max() < 1e-6


def test_halo_buckets_change_nothing(spark):
    rows = walk(2600)
    plain, cut = P.features(bars(spark, rows)), P.features(bars(spark, rows), halo_rows=512)
    assert all(r.within for r in P.parity(plain, cut, 1e-9).collect())
    endless = P.endless_vwap(numbered(bars(spark, rows)), rows=100)
    whole = P.endless_vwap(numbered(bars(spark, rows)))
    gap = endless.select("seq", F.col("vwap").alias("a")).join(whole.select("seq", F.col("vwap").alias("b")), "seq").agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert gap < 1e-8


def test_averages_after_long_falls_and_rests(spark):
    """Gains that end for longer than two stretches, and a rest in which nothing moves at all."""
    close = [*(100 + i % 3 for i in range(50)), *(100 - 0.01 * i for i in range(1300)), *[87.0] * 1200, 87.5, 87.2]
    rows = [("NQ", r[1], i, c, c, c, c, 10.0) for i, (r, c) in enumerate(zip(walk(len(close)), map(float, close)))]
    found = table(P.features(bars(spark, rows)))
    assert np.abs(found - sequential_features(rows))[:, [2, 4, 5]].max() < 1e-6


def test_bounds_warm_up_and_numbers(spark):
    found = P.features(bars(spark, walk(300)))
    x = table(found)
    assert np.isfinite(x).all()
    assert x[:, 3].min() >= -3 and x[:, 3].max() <= 3 and x[:, 4].min() >= 0 and x[:, 4].max() <= 5 and np.abs(x[:, 5]).max() <= 3
    assert found.where("ready").agg({"bar_no": "min"}).first()[0] == 99


@pytest.mark.parametrize("case", ["flat", "no_volume"])
def test_degenerate_series_give_numbers(spark, case):
    rows = [("NQ", r[1], i, *((100.0,) * 4 if case == "flat" else (100 + 0.1 * i,) * 4), 1000.0 if case == "flat" else 0.0) for i, r in enumerate(walk(200))]
    assert np.isfinite(table(P.features(bars(spark, rows)))).all()


def test_session_resets_the_vwap(spark):
    rows = walk(400)
    whole, reset = P.features(bars(spark, rows), session=None), P.features(bars(spark, rows))
    assert len({r.session_id for r in reset.select("session_id").collect()}) == 2
    a, b = table(whole)[:, 3], table(reset)[:, 3]
    assert np.allclose(a[:288], b[:288]) and not np.allclose(a[288:], b[288:])


def test_edges_of_the_contract(spark):
    rows = walk(60)
    rows[40] = (*rows[40][:7], 0.0)
    row = P.features(bars(spark, rows), contract_edges=True).where("bar_no = 40").first()
    assert row.volume_z == 0.0 and row.vwap_distance == 0.0


def test_empty_and_single_bar(spark):
    assert P.features(bars(spark, [])).count() == 0
    assert P.features(bars(spark, [("NQ", START, 0, 1.0, 2.0, 0.5, 1.5, 10.0)])).count() == 1
