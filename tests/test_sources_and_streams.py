import json

import numpy as np
import pytest
from helpers import bars, sequential_features, walk
from pyspark.sql import functions as F

from barwright.operators import drift, hmm, risk
from barwright.operators import orderflow as O
from barwright.operators.features import features
from barwright.plans import frames, registry
from barwright.plans.frames import SAMPLE_MODEL
from barwright.sources import bars as B
from barwright.sources import messages as M
from barwright.sources.schema import FEATURES, MODEL, instruments, match_profile, session_id
from barwright.streaming import flows, stateful, ticks


def test_headers():
    assert B.normalised([" Date/Time ", "OPEN", "High", "low", "Last", "Vol"]) == B.REQUIRED
    with pytest.raises(ValueError, match="missing"):
        B.normalised(["timestamp", "open"])
    with pytest.raises(ValueError, match="several"):
        B.normalised(["Date", "Time", "open", "high", "low", "close", "volume"])


def test_csv_directory(spark, tmp_path):
    (tmp_path / "nq 5min export.csv").write_text("Date/Time,Open,High,Low,Last,Vol\n2024-01-02 18:05:00,1,2,0.5,1.5,\nsoon,1,2,0.5,1.5,3\n2024-01-02 18:00:00,1,2,0.5,n/a,3\n01/03/2024 10:00,1,2,1,2,7\n")
    (tmp_path / "UB_2024.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-02 18:00:00,1,2,0.5,1.5,10\n")
    (tmp_path / "readme.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-02 18:00:00,1,2,0.5,1.5,10\n")
    found = B.read_directory(spark, str(tmp_path)).orderBy("symbol", "ts").collect()
    assert [(r.symbol, r.volume) for r in found] == [("NQ", 0.0), ("NQ", 7.0), ("UB", 10.0)]
    assert B.read_directory(spark, str(tmp_path), start="2024-01-03").count() == 1
    raw = B.read_bars_csv(spark, str(tmp_path / "nq 5min export.csv"))
    assert B.dropped_rows(raw).first().dropped == 2


def test_many_files_are_one_scan(spark, tmp_path):
    """300 files under 3 headers: as many scans as for one file, and every bar under its own header's names."""
    heads = ["timestamp,open,high,low,close,volume", "Vol,Last,LOW,High,Open,note,Date/Time", " Date ,Open,High,Low,Close,Volume"]
    cells = {"timestamp": "2024-01-02 10:{:02d}:00", "open": "{0}.1", "high": "{0}.4", "low": "{0}.0", "close": "{0}.2", "volume": "{0}"}
    for i in range(300):
        names = [n for n in B.normalised(heads[i % 3].split(","))]
        lines = [",".join(cells.get(n, "free").format(k) for n in names) for k in range(i % 4)]
        (tmp_path / f"{'NQ ES CL'.split()[i % 3]} {i}.csv").write_text("\n".join([heads[i % 3], *lines]) + "\n")
    (tmp_path / "empty NQ.csv").write_text("")
    found = B.read_directory(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1
    rows = found.collect()
    assert len(rows) == sum(i % 4 for i in range(300)) and {r.symbol for r in rows} == {"NQ", "ES", "CL"}
    for r in rows:
        k = r.ts.minute
        assert (r.open, r.high, r.low, r.close, r.volume) == (float(f"{k}.1"), float(f"{k}.4"), float(f"{k}.0"), float(f"{k}.2"), float(k))
    (tmp_path / "GC.csv").write_text("timestamp,open,high,low,volume\n")
    with pytest.raises(ValueError, match="missing: close"):
        B.read_directory(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no CSV"):
        B.read_directory(spark, str(tmp_path / "none"))


def test_export_ingest_replaces_a_symbol(spark, tmp_path):
    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "bars", "check"))
    (tmp_path / "in").mkdir()
    head, other = "timestamp,open,high,low,close,volume", "Vol,Last,Low,High,Open,Date"
    line = "2024-01-02 18:0{}:00,1,2,0.5,1.5,10\n"
    for name, n in (("NQ_a.csv", 3), ("ES.csv", 2), ("memo.csv", 1)):
        (tmp_path / "in" / name).write_text(head + "\n" + "".join(line.format(i) for i in range(n)))
    (tmp_path / "in" / "CL.csv").write_text(other + "\n10,-1.5,3,2,1,2024-01-02 18:00:00\n10,-1.5,0.5,2,1,2024-01-02 18:00:00\n10,x,0.5,2,1,2024-01-02 18:00:00\n")
    M.ingest_exports(spark, folder, table, checkpoint).awaitTermination()
    (tmp_path / "in" / "NQ_b.csv").write_text(head + "\n" + line.format(9))
    M.ingest_exports(spark, folder, table, checkpoint).awaitTermination()
    assert {r.symbol: r["count"] for r in spark.read.parquet(table).groupBy("symbol").count().collect()} == {"NQ": 1, "ES": 2, "CL": 2}
    assert spark.read.parquet(f"{table}-quarantine").count() == 1 and spark.read.parquet(f"{table}-dropped").count() == 1
    warned = {(r.batch, r.symbol, r.check): r.n for r in spark.read.parquet(f"{table}-warnings").collect()}
    assert warned[0, "CL", "duplicate_timestamps"] == 1 and warned[0, "CL", "high_below_low"] == 1 and warned[0, "CL", "close_not_positive"] == 2
    assert warned[0, "NQ", "few_bars"] == 3 and warned[1, "NQ", "few_bars"] == 1 and (1, "ES", "few_bars") not in warned


def test_a_batch_that_is_tried_again_replaces_what_it_left(spark, tmp_path):
    """A batch that fails once it has written its bars runs again under its number: nothing is there twice."""
    from unittest import mock

    from barwright.operators import quality

    folder, table, checkpoint = (str(tmp_path / x) for x in ("in", "bars", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "NQ.csv").write_text("timestamp,open,high,low,close,volume\n2024-01-02 18:00:00,1,2,0.5,1.5,10\nsoon,1,2,0.5,1.5,10\n")
    with mock.patch.object(quality, "quality", side_effect=RuntimeError("lost")), pytest.raises(Exception, match="lost"):
        M.ingest_exports(spark, folder, table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == 1
    M.ingest_exports(spark, folder, table, checkpoint).awaitTermination()
    assert spark.read.parquet(table).count() == 1 and spark.read.parquet(f"{table}-dropped").count() == 1 and spark.read.parquet(f"{table}-warnings").count() == 1


def test_trades_models_requests(spark, tmp_path):
    (tmp_path / "pnl.txt").write_text("# trades\n10.5\n\nten\n-3\n")
    good, bad = M.read_trades(spark, str(tmp_path / "pnl.txt"))
    assert [r.pnl for r in good.orderBy("trade_id").collect()] == [10.5, -3.0] and bad.count() == 1
    (tmp_path / "models").mkdir()
    (tmp_path / "models" / "a.json").write_text(json.dumps(SAMPLE_MODEL, indent=1))
    (tmp_path / "models" / "b.json").write_text(json.dumps(SAMPLE_MODEL | {"schema_version": 1}))
    (tmp_path / "models" / "c.json").write_text("no json")
    sound, refused = M.read_models(spark, str(tmp_path / "models"))
    assert sound.count() == 1 and refused.count() == 2
    M.write_models(sound.drop("file"), str(tmp_path / "registry"), str(tmp_path / "export"))
    M.write_models(sound.drop("file").withColumn("metadata", F.col("metadata").withField("trained_at", F.lit("2027"))), str(tmp_path / "registry"))
    assert M.registry(spark, str(tmp_path / "registry")).first().metadata.trained_at == "2027"
    text = spark.createDataFrame([('{"type":"infer","symbol":"NQ","timestamp":"2024-01-02T00:00:00Z","features":[1,2]}',), ('[{"type":"infer","symbol":"ES"},{"type":"x"}]',), ("oops",)], "value string")
    assert sorted(str(r.type) for r in M.parse_requests(text).collect()) == ["None", "infer", "infer", "x"]


def test_profile_matching(spark):
    named = spark.createDataFrame([("MNQ 12-26", None), ("es 03-27", "CL"), ("other", None)], "instrument string, wish string")
    assert [r.profile for r in match_profile(named, instruments(spark), override="wish").collect()] == ["NQ", "CL", None]


def streamed(spark, tmp_path, batch, build, n_files=3, mode="append"):
    """The rows of a stream over the files of a batch frame."""
    source = str(tmp_path / "source")
    batch.repartitionByRange(n_files, "ts", "seq").write.parquet(source)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 100).parquet(source)
    stateful.use_rocksdb(spark)
    out = str(tmp_path / "out")
    name = "t" + tmp_path.name.replace("-", "_")
    if mode == "append":
        build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)
    build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_streaming_features_equal_the_batch(spark, tmp_path):
    rows = walk(150)
    found = streamed(spark, tmp_path, bars(spark, rows), lambda s: stateful.apply(s, stateful.FeatureState()))
    x = np.array([[r[f] for f in FEATURES] for r in found.orderBy("seq").collect()])
    assert np.abs(x - sequential_features(rows)).max() < 1e-6


def test_streaming_scores_restart_with_a_new_model(spark, tmp_path):
    rows = features(bars(spark, walk(60))).select("symbol", "ts", "seq", "bar_no", "features")
    models = spark.createDataFrame([SAMPLE_MODEL], MODEL)
    batch = {r.seq: r.state_probs for r in hmm.filtered(rows, SAMPLE_MODEL).collect()}
    asked = flows.with_latest_models(rows.drop("bar_no"), models)
    renewed = asked.withColumn("model", F.when(F.col("seq") >= 40, F.regexp_replace("model", "2024-03-01T00", "2024-03-02T00")).otherwise(F.col("model")))
    found = {r.seq: r for r in streamed(spark, tmp_path, renewed, lambda s: stateful.apply(s, stateful.ScoreState())).collect()}
    assert all(np.allclose(found[i].state_probs, batch[i]) for i in range(40))
    assert found[40].model_version != found[39].model_version
    # The batch form under both versions of the model equals the stream.
    later = rows.agg(F.min(F.when(F.col("seq") >= 40, F.col("ts")))).first()[0]
    first = models.withColumn("valid_from", F.lit(None).cast("timestamp"))
    second = models.withColumns({"valid_from": F.lit(later), "metadata": F.col("metadata").withField("trained_at", F.lit("2024-03-02T00:00:00Z"))})
    for r in hmm.filtered(rows, first.unionByName(second)).collect():
        assert np.allclose(found[r.seq].state_probs, r.state_probs) and found[r.seq].model_version == r.model_version


def test_streaming_flow_equals_the_batch(spark, tmp_path):
    sided = frames.sided(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streamed(spark, tmp_path, sided.select("symbol", "ts", "seq", "buy_vol", "sell_vol"), flows.flow_stream, mode="append")
    batch = {(r.symbol, r.ts): r.delta for r in O.bar_flow(sided).collect()}
    got = {(r.symbol, r.ts): r.delta for r in found.collect()}
    assert got and all(batch[k] == v for k, v in got.items()) and len(got) >= len(batch) - 10


def tick_rows(n=4000, seed=3):
    """Ticks of three symbols over a day and a half; many share a time."""
    from datetime import datetime, timedelta

    dice = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        at = datetime(2024, 1, 2) + timedelta(seconds=int(30 * (i // 2)))
        rows.append((("A", "B", "C")[i % 3], at, i, "BAL"[int(dice.integers(0, 3))], float(100 + dice.integers(-3, 4)), float(dice.integers(0, 9))))
    return rows


TICK = "symbol string, ts timestamp, seq bigint, kind string, price double, volume double"


def feed(spark, folder, batches):
    """Files of ticks, each of which a stream takes in as a batch of its own."""
    import time

    for rows in batches:
        spark.createDataFrame(rows, TICK).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def run_ticks(spark, tmp_path, folder, lateness="1 hour"):
    stateful.use_rocksdb(spark)
    good, _ = M.ticks_of(spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(folder))
    out = {name: str(tmp_path / name) for name in ("bars", "late", "check")}
    ticks.write_tick_flow(good, out["bars"], out["late"], out["check"], "1 hour", lateness).awaitTermination()
    read = lambda name: spark.read.parquet(out[name])
    return {(r.symbol, r.ts): (r.buy_vol, r.sell_vol, r.delta, r.imbalance) for r in read("bars").collect()}, sorted(r.seq for r in read("late").collect())


def batch_flow(spark, rows):
    found = O.bar_flow(O.with_sides(O.with_quotes(spark.createDataFrame(rows, TICK))))
    return {(r.symbol, r.ts): (r.buy_vol, r.sell_vol, r.delta, r.imbalance) for r in found.collect()}


def test_a_tick_stream_gives_the_batch_bars(spark, tmp_path):
    """Ticks out of order by less than the lateness, within files and between them: bars, quotes and sides are the batch's."""
    dice, rows = np.random.default_rng(9), tick_rows()
    # Each tick moves by up to 50 of the 60 minutes that are allowed.
    order = sorted(range(len(rows)), key=lambda i: rows[i][1].timestamp() + 60 * dice.integers(0, 50))
    shuffled = [rows[i] for i in order]
    folder = str(tmp_path / "in")
    feed(spark, folder, [shuffled[i : i + 900] for i in range(0, len(shuffled), 900)])
    found, late = run_ticks(spark, tmp_path, folder)
    batch = batch_flow(spark, rows)
    assert late == [] and all(found[k] == batch[k] for k in found)
    # Only the bars that the last hour keeps open are missing.
    assert len(batch) - 9 <= len(found) < len(batch)


def test_late_ticks_reach_the_side_table_and_change_no_bar(spark, tmp_path):
    rows = tick_rows(2400)
    clock = {s: max(r[1] for r in rows[:1600] if r[0] == s) for s in "ABC"}
    behind = [(s, clock[s].replace(hour=clock[s].hour - 3), 10_000 + i, kind, 101.0, 1e6) for i, (s, kind) in enumerate([("A", "L"), ("A", "B"), ("B", "A"), ("C", "L")])]
    folder = str(tmp_path / "in")
    feed(spark, folder, [rows[:800], rows[800:1600], [*behind, *rows[1600:2000]], rows[2000:]])
    found, late = run_ticks(spark, tmp_path, folder)
    batch = batch_flow(spark, rows)
    assert late == [r[2] for r in behind]
    assert found and all(found[k] == batch[k] for k in found) and len(found) >= len(batch) - 9


def test_what_a_tick_stream_keeps_between_batches(spark, tmp_path):
    """Tables of the ticks whose bars are open, and two quotes a symbol; a batch tried again gives the same. Quotes that are no numbers count as in the batch."""
    rows = [r if i % 97 else (*r[:3], "BA"[i % 2], float("nan"), r[5]) for i, r in enumerate(tick_rows(3200))]
    folder = str(tmp_path / "in")
    feed(spark, folder, [rows[i : i + 800] for i in range(0, 3200, 800)])
    first = run_ticks(spark, tmp_path, folder)
    batch = batch_flow(spark, rows)
    assert all(first[0][k] == batch[k] for k in first[0]) and len(first[0]) >= len(batch) - 9 and first[1] == []
    kept = tmp_path / "check" / "flow" / "waiting"
    assert sorted(p.name for p in kept.iterdir()) == ["batch=2", "batch=3"]
    edge = {s: (max(r[1] for r in rows if r[0] == s)).replace(minute=0, second=0) for s in "ABC"}
    waiting = spark.read.parquet(str(kept / "batch=3")).collect()
    open_ = [r for r in rows if (edge[r[0]] - r[1]).total_seconds() <= 3600]
    assert sorted(r.seq for r in waiting if (edge[r.symbol] - r.ts).total_seconds() <= 3600) == sorted(r[2] for r in open_)
    assert len(waiting) == len(open_) + 6
    for name in ("3", ".3.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    assert run_ticks(spark, tmp_path, folder) == first


def test_a_stream_of_more_rows_is_more_files(spark, monkeypatch):
    rows = spark.createDataFrame(tick_rows(), TICK)
    files = lambda: spark.read.parquet(registry._files(rows)[1]).select(F.input_file_name()).distinct().count()
    assert files() == 4
    monkeypatch.setattr(registry, "ROWS_A_FILE", 1000)
    assert files() == 8


def test_sessions_of_another_time_zone(spark, tmp_path):
    """Sessions from 18:00 in New York, over a change of clocks, in the stream as in the batch."""
    from datetime import datetime, timedelta

    rows = [(s, datetime(2024, 3, 8, 12) + timedelta(minutes=30 * i), *rest) for i, (s, _, *rest) in enumerate(walk(230))]
    frame = bars(spark, rows)
    zone = {"session": "America/New_York", "session_start": "18:00"}
    (tmp_path / "f").mkdir(), (tmp_path / "h").mkdir(), (tmp_path / "r").mkdir()
    found = {r.seq: r.vwap_distance for r in streamed(spark, tmp_path / "f", frame, lambda s: stateful.apply(s, stateful.FeatureState(), **zone)).collect()}
    batch = features(frame, **zone).collect()
    assert all(abs(found[r.seq] - r.vwap_distance) < 1e-6 for r in batch)
    other = {r.seq: r.vwap_distance for r in features(frame).collect()}
    assert sum(abs(found[i] - other[i]) > 1e-3 for i in found) > 20
    # The session that begins on the evening of the 9th has an hour less: 18:00 is 23:00 UTC before the change and 22:00 after it.
    sessions = {r.ts: r.session_id for r in batch}
    assert sessions[datetime(2024, 3, 9, 23)] != sessions[datetime(2024, 3, 9, 22, 30)] and sessions[datetime(2024, 3, 10, 22)] != sessions[datetime(2024, 3, 10, 21, 30)]

    from barwright.operators import decide
    from test_flow_and_risk import RISK, risk_events

    dice = np.random.default_rng(2)
    proposals = frame.select("symbol", "ts", "seq", F.col("seq").alias("bar_no")).withColumns({"session_id": session_id(F.col("ts"), "America/New_York", "18:00"), "state": F.array(*(F.lit(int(x)) for x in dice.integers(0, 3, 230)))[F.col("seq").cast("int")], "confidence": F.lit(0.9), "step_ll": F.lit(0.0)})
    want = {r.bar_no: (r.regime, r.flips) for r in decide.hysteresis(proposals, dwell=1, max_flips=2).collect()}
    got = streamed(spark, tmp_path / "h", proposals, lambda s: stateful.apply(s, stateful.HysteresisState(dwell=1, max_flips=2), **zone)).collect()
    assert {r.seq: (r.regime, r.flips) for r in got} == want
    events = spark.createDataFrame(risk_events(5), RISK).withColumn("ts", F.expr("timestamp '2024-03-08 12:00:00' + make_dt_interval(0, 0, 0, seq * 1300.0)"))
    want = {(r.account, r.seq): (r.live_state, r.day_pnl, r.day_trades, r.losses) for r in risk.live_state(events, 60, 70, 2, 3, **zone).collect()}
    got = streamed(spark, tmp_path / "r", events, lambda s: stateful.apply(s, stateful.RiskState(60, 70, 2, 3), "account", **zone)).collect()
    assert {(r.account, r.seq): (r.live_state, r.day_pnl, r.day_trades, r.losses) for r in got} == want


def test_streaming_regimes_and_risk(spark, tmp_path):
    from test_flow_and_risk import proposals, sequential_hysteresis

    states = [0, 0, 1, 1, 1, 2, 1, 2, 2, 2, 0] * 6
    batch = proposals(spark, states, 10**6).withColumns({"seq": F.col("bar_no"), "step_ll": F.lit(-2.0)})
    (tmp_path / "a").mkdir(), (tmp_path / "c").mkdir()
    found = streamed(spark, tmp_path / "a", batch, lambda s: stateful.apply(s, stateful.HysteresisState(max_flips=2))).orderBy("seq").collect()
    assert [(r.regime, r.flips) for r in found] == sequential_hysteresis(states, 10**6)
    from test_flow_and_risk import RISK, risk_events

    rows = spark.createDataFrame(risk_events(5), RISK)
    batch_states = {r.seq: (r.live_state, r.day_pnl, r.day_trades, r.losses) for r in risk.live_state(rows, 60, 70, 2, 3).collect()}
    live = streamed(spark, tmp_path / "c", rows, lambda s: stateful.apply(s, stateful.RiskState(60, 70, 2, 3), "account")).collect()
    assert {r.seq: (r.live_state, r.day_pnl, r.day_trades, r.losses) for r in live} == batch_states


def test_streaming_drift_equals_the_batch(spark, tmp_path):
    from test_models import evidence

    states = [i % 3 if i % 7 else 0 for i in range(160)]
    rows = evidence(spark, states, ll=-3.5, shift=0.1)
    models = spark.createDataFrame([SAMPLE_MODEL], MODEL)
    batch = drift.decision(drift.metrics(rows, models, 3)).first()
    asked = rows.withColumn("model", F.lit(json.dumps(SAMPLE_MODEL)))
    last = streamed(spark, tmp_path, asked, lambda s: stateful.apply(s, stateful.DriftState())).orderBy(F.desc("seq")).first()
    for name in ("n", "ready", "occupancy_drift", "transition_drift", "likelihood_drop", "retrain"):
        assert last[name] == batch[name], name
    assert last.reasons.split(",") == batch.reasons
    # The batch's rolling form equals the stream after every event, over a window that slides, in buckets.
    (tmp_path / "w").mkdir()
    found = streamed(spark, tmp_path / "w", asked, lambda s: stateful.apply(s, stateful.DriftState(window=60))).collect()
    for size in (64, 10**6):
        rolling = {r.seq: r for r in drift.decision(drift.rolling_metrics(B.numbered(rows), models, 3, window=60, rows=size)).collect()}
        assert len(rolling) == len(found)
        for r in found:
            own = rolling[r.seq]
            for name in ("n", "ready", "retrain"):
                assert r[name] == own[name], (name, r.seq)
            for name in ("occupancy_drift", "transition_drift", "likelihood_drop"):
                assert abs(r[name] - own[name]) < 1.1e-4, (name, r.seq)
            assert r.reasons == ",".join(own.reasons)


def test_ticks_responses_and_status(spark, tmp_path):
    rows = [("NQ", "2024-01-02 10:00:00", 1, "B", 9.0, 1.0), ("NQ", "2024-01-02 10:00:00", 2, "L", 9.0, None), ("NQ", None, 3, "L", 9.0, 1.0), ("NQ", "2024-01-02 10:00:00", 4, "X", 9.0, 1.0), ("NQ", "2024-01-02 10:00:00", 5, "A", -1.0, 1.0), (None, "2024-01-02 10:00:00", 6, "L", 9.0, 1.0)]
    raw = spark.createDataFrame(rows, "symbol string, ts string, seq bigint, kind string, price double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))
    raw.write.parquet(str(tmp_path / "ticks"))
    good, bad = M.read_ticks(spark, str(tmp_path / "ticks"))
    assert [(r.seq, r.volume) for r in good.orderBy("seq").collect()] == [(1, 1.0), (2, 0.0)] and bad.count() == 4
    stream, _ = M.stream_ticks(spark, str(tmp_path / "ticks"))
    M.write_responses(stream.select("symbol", "seq"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(json.loads(r.value)["seq"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [1, 2]
    models = spark.createDataFrame([SAMPLE_MODEL], MODEL)
    log = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "ticks")).select("symbol", F.lit(False).alias("is_error"), F.lit(1.0).alias("latency_ms"))
    flows.write_status(log, lambda: models, str(tmp_path / "status"), str(tmp_path / "c2")).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "status")).first()
    assert (row.symbol, row.k, row.requests) == ("NQ", 3, 5)


def test_status_stream(spark, tmp_path):
    log = spark.createDataFrame([("NQ", bars(spark, walk(1)).first().ts, i, i == 0, float(i)) for i in range(4)], "symbol string, ts timestamp, seq bigint, is_error boolean, latency_ms double")
    row = streamed(spark, tmp_path, log, flows.status_stream, mode="complete").first()
    assert (row.requests, row.errors, row.mean_latency_ms) == (4, 1, 1.5)
