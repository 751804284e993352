from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import decide, quality, resample, risk
from barwright.operators import orderflow as O
from barwright.sources import schema

T0 = datetime(2024, 1, 2, 10)


def ticks(spark, rows):
    return spark.createDataFrame([("NQ", T0 + timedelta(minutes=m), i, k, float(p), float(v)) for i, (m, k, p, v) in enumerate(rows)], schema.TICKS)


def test_quotes_sides_and_bars(spark):
    rows = [(0, "L", 10, 5), (1, "B", 9, 0), (2, "A", 11, 0), (3, "L", 11, 4), (4, "L", 9, 6), (5, "L", 10, 2), (6, "L", 10, 0), (24 * 60, "L", 12, 3)]
    for by_day in (True, False):
        found = O.with_sides(O.with_quotes(ticks(spark, rows), by_day)).orderBy("ts").collect()
        assert [(r.bid, r.ask) for r in found] == [(None, None), (9, 11), (9, 11), (9, 11), (9, 11)]
        assert [(r.buy_vol, r.sell_vol) for r in found] == [(2.5, 2.5), (4, 0), (0, 6), (1, 1), (3, 0)]
    flow = O.bar_flow(O.with_sides(O.with_quotes(ticks(spark, rows)))).orderBy("ts").first()
    assert (flow.buy_vol, flow.sell_vol, flow.delta) == (7.5, 9.5, -2.0) and abs(flow.imbalance + 2 / 17) < 1e-12
    bar = O.bars_from_ticks(ticks(spark, rows)).orderBy("ts").first()
    assert (bar.open, bar.high, bar.low, bar.close, bar.volume) == (10, 11, 9, 10, 17)


def test_large_orders_need_ten_sizes(spark):
    few = ticks(spark, [(i, "L", 10, 1) for i in range(8)] + [(9, "L", 10, 100)])
    many = ticks(spark, [(i, "L", 10, 1) for i in range(20)] + [(21, "L", 10, 100)])
    assert O.large_orders(few).first().large_orders == 0 and O.large_orders(many).first().large_orders == 1


@pytest.mark.parametrize(("signal", "z", "imbalance", "n", "expected"), [(1, 2.0, 0.0, 9, "confirm"), (1, 0.0, 0.2, 9, "confirm"), (1, 2.0, -0.2, 9, "neutral"), (1, -2.0, -0.2, 9, "deny"), (-1, 2.0, 0.2, 9, "deny"), (0, 2.0, 0.2, 9, "neutral"), (1, 2.0, 0.2, 3, "neutral")])
def test_confirmation(spark, signal, z, imbalance, n, expected):
    row = spark.range(1).select(O.confirmation(F.lit(signal), F.lit(z), F.lit(imbalance), F.lit(n)).alias("c")).first()
    assert row.c == expected


def proposals(spark, states, per_session=50, confidence=0.9):
    rows = [("NQ", T0 + timedelta(minutes=i), i, str(i // per_session), int(s), confidence) for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, bar_no bigint, session_id string, state int, confidence double")


def sequential_hysteresis(states, per_session, dwell=3, most=2):
    regime = candidate = -1
    count = flips = 0
    out = []
    for i, s in enumerate(states):
        if i % per_session == 0:
            flips = 0
        if flips < most:
            if regime < 0:
                regime = candidate = s
                count = dwell
            elif s == regime:
                candidate, count = s, 0
            else:
                count = count + 1 if s == candidate else 1
                candidate = s
                if count >= dwell:
                    regime, count, flips = s, 0, flips + 1
        out.append((regime, flips))
    return out


@pytest.mark.parametrize("per_session", [1, 7, 40, 1000])
def test_hysteresis_equals_the_sequential_automaton(spark, per_session):
    import random

    random.seed(per_session)
    states, s = [], 0
    for _ in range(200):
        s = s if random.random() < 0.7 else random.randrange(3)
        states.append(s)
    found = decide.hysteresis(proposals(spark, states, per_session), max_flips=2).orderBy("bar_no").collect()
    assert [(r.regime, r.flips) for r in found] == sequential_hysteresis(states, per_session)
    assert {r.regime for r in decide.hysteresis(proposals(spark, states, per_session, 0.1)).collect()} == {-1}


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_hysteresis_in_any_blocks(spark, block):
    states = [0, 0, 1, 1, 1, 2, 1, 2, 2, 2, 0] * 6
    found = decide.hysteresis(proposals(spark, states, 20), max_flips=2, block=block).orderBy("bar_no").collect()
    assert [(r.regime, r.flips) for r in found] == sequential_hysteresis(states, 20)


RISK = "account string, ts timestamp, seq bigint, kind string, pnl double"


def risk_events(seed, n=300, days=12):
    import random

    r = random.Random(seed)
    kinds = ["signal", "entry", "exit", "entry", "exit", "stop", "clear", "other"]
    return [(f"a{i % 3}", T0 + timedelta(days=i * days // n), i, r.choices(kinds, [3, 4, 4, 4, 4, 1, 1, 1])[0], r.choice([None, -30.0, -5.0, 10.0, 40.0])) for i in range(n)]


def sequential_risk(rows, max_loss, profit_lock, max_trades, max_losses):
    held, out = {}, {}
    for account, ts, seq, kind, pnl in rows:
        s = held.setdefault(account, {"live": "idle", "day": None, "pnl": 0.0, "trades": 0, "losses": 0})
        if ts.date() != s["day"]:
            s["day"] = ts.date()
            if s["live"] != "emergency_stop":
                s |= {"live": "idle", "pnl": 0.0, "trades": 0, "losses": 0}
        if kind in ("stop", "clear"):
            s["live"] = "emergency_stop" if kind == "stop" else "idle"
        elif kind == "exit":
            s["pnl"] += pnl or 0.0
            s["losses"] = s["losses"] + 1 if (pnl or 0) < 0 else 0
            locked = s["pnl"] <= -max_loss or s["pnl"] >= profit_lock or s["losses"] >= max_losses
            if s["live"] != "emergency_stop":
                s["live"] = "locked" if locked else "halted" if s["trades"] >= max_trades else "idle"
        elif kind == "entry" and s["live"] in ("idle", "armed"):
            s["live"], s["trades"] = "in_trade", min(s["trades"] + 1, max_trades)
        elif kind == "signal" and s["live"] == "idle":
            s["live"] = "armed"
        out[seq] = (s["live"], s["pnl"], s["trades"], s["losses"])
    return out


@pytest.mark.parametrize("block", [4, 4096])
def test_live_states_follow_the_automaton(spark, block):
    for seed in (1, 2):
        rows = risk_events(seed)
        found = risk.live_state(spark.createDataFrame(rows, RISK).repartition(4), 60, 70, 2, 3, block).collect()
        assert {r.seq: (r.live_state, r.day_pnl, r.day_trades, r.losses) for r in found} == sequential_risk(rows, 60, 70, 2, 3)
    locked = [("a", T0, 1, "entry", None), ("a", T0, 2, "exit", -2000.0), ("a", T0, 3, "entry", None), ("a", T0 + timedelta(days=1), 4, "entry", None)]
    assert [r.live_state for r in risk.live_state(spark.createDataFrame(locked, RISK)).orderBy("seq").collect()] == ["in_trade", "locked", "locked", "in_trade"]
    assert risk.live_state(spark.createDataFrame([], RISK)).count() == 0


def trades(spark, pnls, account="a", day_every=1000):
    rows = [(account, i, T0 + timedelta(days=i // day_every, minutes=i), float(p)) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, schema.TRADES)


def test_risk_states_and_locks(spark):
    rows = risk.risk_state(risk.daily(trades(spark, [-5, -6, -7, 100, 1, 1], day_every=3)), max_loss=17, profit_lock=100, max_trades=3, max_losses=2).orderBy("trade_id").collect()
    assert [r.risk_state for r in rows] == ["idle", "locked_streak", "locked_loss", "locked_profit", "locked_profit", "locked_profit"]
    locked = risk.evaluation(trades(spark, [50, -30, -5, 40, -60, 90], day_every=2), trailing_limit=60, daily_limit=29, target=100).orderBy("trade_id").collect()
    assert [r.lock for r in locked] == [None, None, None, None, "trailing", "trailing"]
    assert [r.peak for r in locked] == [50, 50, 50, 55, 55, 85] and locked[3].progress == 0.55


def plain_evaluation(pnls, days, trailing_limit, daily_limit):
    """Trade by trade: (cum, peak, fall, day's sum, lock), and the curve's largest fall and longest run of losses."""
    out, cum, peak, day, locked, today, down = [], 0.0, 0.0, None, False, 0.0, False
    top, fall, run, longest = None, 0.0, 0, 0
    for pnl, own in zip(pnls, days, strict=True):
        if own != day:
            day, today, down = own, 0.0, False
        cum, today = cum + pnl, today + pnl
        peak = max(peak, cum)
        locked |= peak - cum >= trailing_limit
        down |= today <= -daily_limit
        out.append((cum, peak, peak - cum, today, "trailing" if locked else "daily" if down else None))
        top = cum if top is None else max(top, cum)
        fall, run = max(fall, top - cum), run + 1 if pnl < 0 else 0
        longest = max(longest, run)
    return out, fall, longest


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_accounts_are_judged_in_blocks(spark, block):
    """Whole-account sums, peaks, locks, falls and runs from blocks of three trades, against trade by trade."""
    dice = np.random.default_rng(21)
    accounts = {"up": dice.integers(-5, 8, 90), "down": dice.integers(-8, 5, 90), "flat": np.zeros(20, int), "lost": np.full(40, -1), "one": np.array([-3])}
    frame = None
    for name, pnls in accounts.items():
        own = trades(spark, pnls, name, day_every=7)
        frame = own if frame is None else frame.unionByName(own)
    found = {(r.account, r.trade_id): (r.cum_pnl, r.peak, r.trailing_dd, r.day_pnl, r.lock) for r in risk.evaluation(frame.repartition(4), 30, 9, 50, block=block).collect()}
    falls = {r.account: r.max_dd for r in risk.drawdowns(frame, block=block).collect()}
    runs = {r.account: r.max_losses for r in risk.streaks(frame, block=block).collect()}
    for name, pnls in accounts.items():
        rows, fall, longest = plain_evaluation(pnls.tolist(), [i // 7 for i in range(len(pnls))], 30, 9)
        assert [found[name, i] for i in range(len(pnls))] == rows
        assert (falls[name], runs[name]) == (fall, longest)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_a_sum_that_equals_a_limit_reaches_it(spark, block):
    """Ten times 0.1 is 0.9999999999999999 in doubles."""
    won = risk.evaluation(trades(spark, [0.1] * 11), 2, 2, 1, block=block).orderBy("trade_id").collect()
    assert [r.target_reached for r in won] == [False] * 9 + [True] * 2 and won[9].cum_pnl == 1.0 and won[9].pnl == 0.1
    for trailing, daily, lock in ((1, 2, "trailing"), (2, 1, "daily")):
        lost = risk.evaluation(trades(spark, [-0.1] * 11), trailing, daily, 1, block=block).orderBy("trade_id").collect()
        assert [r.lock for r in lost] == [None] * 9 + [lock] * 2


def test_fills_pair_with_the_entry_before_them(spark):
    rows = [("a", "ES", T0, 1, 1, 1, 100.0, True), ("a", "ES", T0, 2, -1, 1, 101.0, False), ("a", "ES", T0, 3, -1, 1, 90.0, False), ("a", "ES", T0, 4, -1, 2, 100.0, True), ("a", "ES", T0, 5, 1, 2, 99.0, False)]
    found = risk.paired_fills(spark.createDataFrame(rows, schema.FILLS), schema.instruments(spark)).orderBy("seq").collect()
    assert [r.pnl for r in found] == [50.0, 0.0, 100.0]


def test_simulations(spark):
    wins = resample.summary(resample.simulations(trades(spark, [50] * 100), 40)).first()
    assert (wins.mean_pnl, wins.p5_dd, wins.pass_rate, wins.max_losses) == (5000, 0, 1.0, 0)
    assert resample.summary(resample.simulations(trades(spark, [-50] * 100), 40)).first().pass_rate == 0
    mixed = trades(spark, [(-1) ** i * i for i in range(60)])
    once, again = (sorted(resample.simulations(mixed.repartition(n), 20, 0.2, 3.0, 11).collect()) for n in (1, 5))
    assert [(r.sim, round(r.final_pnl, 6)) for r in once] == [(r.sim, round(r.final_pnl, 6)) for r in again]
    gone = resample.simulations(trades(spark, [5.0]), 30, skip_rate=1.0).collect()
    assert len(gone) == 30 and all((r.final_pnl, r.max_dd, r.max_losses) == (0, 0, 0) for r in gone)
    assert resample.summary(resample.simulations(trades(spark, []), 5)).count() == 0


@pytest.mark.parametrize(("skip", "slip"), [(0.0, 0.0), (0.3, 0.0), (0.2, 5.0)])
def test_simulations_equal_plain_ones(spark, skip, slip):
    """Each simulation again, one trade after another, from the same hashes."""
    import numpy as np

    pnls = [(-1) ** i * (i % 7) for i in range(50)]
    df = trades(spark, pnls).withColumn("h", resample.trade_hash(F.col("account"), F.col("trade_id")))
    known = sorted((r.h, r.pnl) for r in df.collect())
    hashes = np.array([h for h, _ in known]).view(np.uint64)
    sims = np.arange(40)
    unit = lambda stream: ((resample.draws(9, stream, sims, hashes) >> np.uint64(11)) + 0.5) / 2.0**53
    order, skips = resample.draws(9, 0, sims, hashes), unit(1)
    noise = np.sqrt(-2 * np.log(unit(2))) * np.cos(2 * np.pi * unit(3))
    found = {r.sim: r for r in resample.simulations(df, 40, skip, slip, 9).collect()}
    for s in sims:
        total, peak, fall, run, longest = 0.0, None, 0.0, 0, 0
        for i in sorted(range(50), key=lambda i: (int(order[s, i]) >> 6, i)):
            if skips[s, i] < skip:
                continue
            pnl = known[i][1] + slip * noise[s, i]
            total += pnl
            peak = total if peak is None else max(peak, total)
            fall, run = max(fall, peak - total), run + 1 if pnl < 0 else 0
            longest = max(longest, run)
        assert abs(found[s].final_pnl - total) < 1e-9 and abs(found[s].max_dd - fall) < 1e-9 and found[s].max_losses == longest


@pytest.mark.parametrize("n", [1, 2, 40, 512, 1100])
@pytest.mark.parametrize("skip", [0.0, 0.3])
def test_quick_kernels_equal_simulated(n, skip):
    import numpy as np

    random = np.random.default_rng(n)
    pnl, hashes, sims = random.normal(2, 30, n).round(2), np.sort(random.integers(-(2**63), 2**63 - 1, n)).view(np.uint64), np.arange(3, 303)
    plain = resample.simulated(pnl, hashes, sims, skip, 0.0, 5)
    for kind in (None, np.uint64):
        for one, other in zip(plain, resample.shuffled(pnl, hashes, sims, skip, 5, kind), strict=True):
            assert (one == other).all()
    for slippage in (0.0, 20.0):
        assert np.abs(resample.simulated(pnl, hashes, sims, skip, slippage, 5)[0] - resample.totals(pnl, hashes, sims, skip, slippage, 5)).max() < 1e-8


@pytest.mark.parametrize("n", [1, 3, 300, 1023, 1024])
@pytest.mark.parametrize("skip", [0.0, 0.1, 0.97])
def test_sums_of_whole_cents_are_exact(n, skip):
    """In doubles a thousand simulations of dimes add up to many numbers near the right one."""
    import numpy as np

    random = np.random.default_rng(n)
    cents, hashes, sims = random.integers(-30, 50, n) * 10, np.sort(random.integers(-(2**63), 2**63 - 1, n)).view(np.uint64), np.arange(1000)
    final, fall, longest = resample._measured(cents / 100, hashes, sims, skip, 0.0, 5, True)
    whole = resample.simulated(cents, hashes, sims, skip, 0.0, 5)
    assert (final == whole[0] / 100).all() and (fall == whole[1] / 100).all() and (longest == whole[2]).all()
    wide = resample.shuffled(cents * 10**9, hashes, sims, skip, 5)
    assert all((one == other * factor).all() for one, other, factor in zip(wide, whole, (10**9, 10**9, 1), strict=True))


def test_parts_of_a_cent_stay_doubles():
    import numpy as np

    assert resample._hundredths(np.array([0.125, 1.0])) is None and resample._hundredths(np.array([1e300, 0.0])) is None
    assert resample._hundredths(np.array([0.29, -1.1])).tolist() == [29, -110] and resample._hundredths(np.array([3e7])).dtype == np.int64


def test_trades_tied_in_their_keys_are_settled():
    """Hashes that differ in their lowest bits alone differ anywhere in their draws; equal ones stay in place."""
    import numpy as np

    hashes, pnl = np.sort(np.arange(500) // 2 * 3).astype(np.uint64), np.arange(500) % 7 - 3.0
    sims = np.arange(2000)
    for one, other in zip(resample.simulated(pnl, hashes, sims, 0.2, 0.0, 5), resample.shuffled(pnl, hashes, sims, 0.2, 5), strict=True):
        assert (one == other).all()


@pytest.mark.parametrize("n", [1, 37, 600])
def test_a_draw_next_to_the_skip_rate_is_told_by_all_bits(n):
    """Quick kernels look at the draws' upper 31 bits first: here one draw has those of the skip rate."""
    import numpy as np

    random = np.random.default_rng(n)
    pnl, hashes, sims = random.normal(2, 30, n).round(2), np.sort(random.integers(-(2**63), 2**63 - 1, n)).view(np.uint64), np.arange(200)
    own = resample._uniform(resample.draws(5, 1, sims[7:8], hashes))[0, n // 2]
    found = []
    for skip in (own, np.nextafter(own, 1)):
        plain = resample.simulated(pnl, hashes, sims, skip, 0.0, 5)
        assert all((one == other).all() for one, other in zip(plain, resample.shuffled(pnl, hashes, sims, skip, 5), strict=True))
        for slippage in (0.0, 20.0):
            assert np.abs(resample.simulated(pnl, hashes, sims, skip, slippage, 5)[0] - resample.totals(pnl, hashes, sims, skip, slippage, 5)).max() < 1e-8
        found.append(plain[0][7])
    assert found[0] != found[1]


def test_cosine_of_the_bits_of_a_draw():
    import numpy as np

    v = np.linspace(1, 2, 100_001)
    x, square = np.empty_like(v), np.empty_like(v)
    assert np.abs(resample._cosine(v.copy(), x, square) - np.cos(2 * np.pi * (v - 1))).max() < 2e-15


def test_longest_runs_of_any_length():
    import numpy as np

    marks = np.zeros((300, 11), bool)
    lengths = [0, 1, 2, 63, 64, 65, 66, 130, 299, 300, 7]
    for i, length in enumerate(lengths):
        marks[:length, i] = True
    marks[200:203, 1] = True
    assert resample._longest_runs(np.packbits(marks, axis=1), 11).tolist() == [0, 3, *lengths[2:]]


def test_trades_are_copied_only_where_accounts_are_few(spark):
    one = trades(spark, [1.0] * 40)
    many = one.withColumn("account", F.col("trade_id").cast("string"))
    assert resample._blocks(one, 10_000, 16) == 4 and resample._blocks(many, 10_000, 16) == 1 and resample._blocks(one.limit(0), 10_000, 16) == 1
    rows = resample.simulations(one, 7_001, falls=False).groupBy("sim").count().orderBy("sim").collect()
    assert [(r.sim, r["count"]) for r in rows] == [(i, 1) for i in range(7_001)]


def test_stress_equals_summary_of_simulations(spark):
    from functools import reduce

    frames = [trades(spark, [(-1) ** i * (i % 11) * 10.25 for i in range(n)]).withColumn("account", F.lit(str(n))) for n in (1, 30, 90)]
    df = reduce(lambda a, b: a.unionByName(b), frames)
    theirs = resample.summary(resample.simulations(df, 2600, 0.2, seed=3), target=5.0, limit=90.0).orderBy("account").collect()
    ours = resample.stress(df, 2600, 0.2, seed=3, target=5.0, limit=90.0).orderBy("account").collect()
    assert len(ours) == 3 and 0 < sum(r.pass_rate for r in ours)
    for one, other in zip(ours, theirs, strict=True):
        assert {k: v if isinstance(v, str) else round(v, 9) for k, v in one.asDict().items()} == {k: v if isinstance(v, str) else round(v, 9) for k, v in other.asDict().items()}
    assert resample.stress(trades(spark, []), 5).count() == 0


def test_stress_of_a_total_that_equals_the_target(spark):
    """The same trades in any order end at the same total, which is not above itself."""
    row = resample.stress(trades(spark, [0.1, 0.7, -0.3] * 50), 500, target=25.0, limit=1e9).first()
    assert (row.pass_rate, row.mean_pnl, row.p5_pnl, row.p95_pnl) == (0.0, 25.0, 25.0, 25.0)


def test_simulations_are_dealt_to_many_tasks_and_leave_out_what_is_not_asked_for(spark):
    df = trades(spark, [1.0, -2.0, 3.0])
    rows = resample.simulations(df, 30, falls=False)
    assert rows.columns == ["account", "sim", "final_pnl"] and rows.rdd.getNumPartitions() >= resample.TASKS * spark.sparkContext.defaultParallelism
    assert {round(r.final_pnl, 9) for r in rows.collect()} == {2.0}


def test_drawdown_and_streak(spark):
    curve = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([0, 10, 5, 8, 3])], "account string, at int, cum double")
    assert resample.max_drawdown(curve, ["account"]).first().max_dd == 7
    run = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([10, -5, -3, -1, 20, -2, -8])], "account string, at int, pnl double")
    assert resample.losing_streaks(run, ["account"]).first().max_losses == 3


def test_quality_checks(spark):
    from helpers import bars, walk

    rows = [list(r) for r in walk(30)]
    rows[5][4], rows[5][5] = rows[5][5], rows[5][4]
    rows[9][1] = rows[8][1]
    rows[20][6] = -1.0
    for r in rows[25:]:
        r[1] += timedelta(hours=5)
    found = {r.check: r.n for r in quality.quality(bars(spark, [tuple(r) for r in rows])).collect()}
    assert found["few_bars"] == 30 and found["duplicate_timestamps"] == 1 and found["close_not_positive"] == 1 and found["high_below_low"] >= 1 and found["time_gaps"] == 1


def test_gates_and_sizes(spark):
    rows = spark.createDataFrame(
        [(5, False, 1, "deny", None, True), (200, True, 1, "deny", None, True), (200, False, 1, "deny", "daily", True), (200, False, 1, "neutral", "daily", True), (200, False, 1, "neutral", None, False), (200, False, 0, "neutral", None, True), (200, False, -1, "confirm", None, True)],
        "bar_no int, flatten boolean, signal int, confirmation string, lock string, can_enter boolean",
    )
    found = [(r.gate, r.action) for r in decide.decisions(rows).collect()]
    assert found == [("warm_up", 0), ("flatten", 0), ("order_flow", 0), ("evaluation_lock", 0), ("risk_state", 0), ("no_signal", 0), (None, -1)]
    assert decide.decisions(rows, shorts=False).collect()[-1].gate == "side_disabled"
    quiet = decide.sizes(decide.stops(spark.createDataFrame([("ES", 1.0, 0), ("ES", 1.0, 2), ("ES", 0.0, 1)], "symbol string, atr double, regime int"), schema.instruments(spark)), 1000, 5)
    assert sorted((r.stop_distance, r.size) for r in quiet.collect()) == [(0.0, 1), (1.5, 2), (3.0, 1)]
    assert {r.size for r in decide.sizes(quiet.drop("size"), evaluation=True).collect()} == {1}
    modes = schema.instruments(spark, "evaluation").where("symbol = 'NQ'").first()
    assert (modes.confidence_threshold, modes.max_flips, modes.flatten_minutes) == (0.6, 4, 15)
