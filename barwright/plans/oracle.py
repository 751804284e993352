"""DuckDB SQL for the registered queries: the same rows from the same tables, by other means (recursion where Spark scans)."""

from __future__ import annotations

from barwright.plans.frames import LASTING, SAMPLE_MODEL, VERSIONS


def _r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'L' END AS kind,
    100 + value AS price, regexp_extract(props, '[0-9]+')::DOUBLE AS volume
  FROM events)"""
BARS = f"""{TICKS}, bars AS (
  SELECT symbol, date_trunc('hour', ts) AS ts, 0::BIGINT AS seq, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts, seq) AS close, sum(volume) AS volume
  FROM ticks WHERE kind = 'L' GROUP BY symbol, date_trunc('hour', ts))"""
NUMBERED = f"""{BARS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev, ts::DATE AS session_id FROM bars)"""
RETURNS = f"""{NUMBERED}, returns AS (
  SELECT *, CASE WHEN prev > 0 THEN ln(close / prev) ELSE 0.0 END AS log_return,
    CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr,
    greatest(coalesce(close - prev, 0), 0) AS gain, greatest(-coalesce(close - prev, 0), 0) AS loss
  FROM numbered), vols AS (
  SELECT *, coalesce(stddev_samp(log_return) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING), 0) AS realised_vol FROM returns)"""


def _z(x: str, n: int, by: str = "bar_no") -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY {by} ROWS {n - 1} PRECEDING)"
    return f"(({x} - avg({x}) {w}) / greatest(coalesce(stddev_samp({x}) {w}, 0), 1e-10))"


#: The Wilder averages by recursion over bar_no.
WILDER = f"""{RETURNS.replace("WITH ", "")}, seeds AS (
  SELECT *, avg(tr) OVER w AS mtr, avg(gain) OVER w AS mgain, avg(loss) OVER w AS mloss FROM vols WINDOW w AS (PARTITION BY symbol ORDER BY bar_no ROWS 13 PRECEDING)
), wilder AS (
  SELECT symbol, bar_no, tr AS atr, 0.0::DOUBLE AS ag, 0.0::DOUBLE AS al FROM seeds WHERE bar_no = 0
  UNION ALL
  SELECT s.symbol, s.bar_no, CASE WHEN s.bar_no < 13 THEN s.tr WHEN s.bar_no = 13 THEN s.mtr ELSE (w.atr * 13 + s.tr) / 14 END,
    CASE WHEN s.bar_no < 14 THEN 0.0 WHEN s.bar_no = 14 THEN s.mgain ELSE (w.ag * 13 + s.gain) / 14 END,
    CASE WHEN s.bar_no < 14 THEN 0.0 WHEN s.bar_no = 14 THEN s.mloss ELSE (w.al * 13 + s.loss) / 14 END
  FROM wilder w JOIN seeds s ON s.symbol = w.symbol AND s.bar_no = w.bar_no + 1
), smoothed AS (
  SELECT v.*, w.atr, CASE WHEN v.bar_no < 14 THEN 50.0 WHEN w.al < 1e-10 THEN CASE WHEN w.ag > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + w.ag / w.al) END AS rsi
  FROM vols v JOIN wilder w USING (symbol, bar_no))"""


def _features(session: str = "session_id") -> str:
    running = f"OVER (PARTITION BY symbol{', ' + session if session else ''} ORDER BY bar_no)"
    return f"""{WILDER}, priced AS (
  SELECT *, sum((high + low + close) / 3 * volume) {running} / greatest(sum(volume) {running}, 1e-10) AS vwap FROM smoothed
), features AS (
  SELECT symbol, ts, bar_no, session_id, open, high, low, close, volume, atr, {_z("log_return", 100)} AS log_return_z, {_z("realised_vol", 100)} AS realised_vol_z, (rsi - 50) / 50 AS rsi_deviation,
    least(greatest((close - vwap) / greatest(atr, 1e-10), -3), 3) AS vwap_distance, least(greatest((high - low) / greatest(atr, 1e-10), 0), 5) AS range_ratio,
    CASE WHEN bar_no = 0 THEN 0.0 ELSE least(greatest({_z("volume", 20)}, -3), 3) END AS volume_z
  FROM priced)"""


NAMES = ["log_return_z", "realised_vol_z", "rsi_deviation", "vwap_distance", "range_ratio", "volume_z"]
FEATURES = _features()


def _log_density(i: int) -> str:
    terms = " + ".join(f"ln({v}) + ({x} - {m}) * ({x} - {m}) / {v}" for x, m, v in zip(NAMES, SAMPLE_MODEL["means"][i], SAMPLE_MODEL["variances"][i], strict=True))
    return f"(-0.5 * (6 * ln(2 * pi()) + {terms}))"


def _recursive_scores() -> str:
    a, p = SAMPLE_MODEL["transition_matrix"], SAMPLE_MODEL["initial_probs"]
    first = [" + ".join(f"{p[i]} * {a[i][j]}" for i in range(3)) for j in range(3)]
    later = [" + ".join(f"f.p{i} * {a[i][j]}" for i in range(3)) for j in range(3)]
    weigh = lambda q: [f"ln(greatest({q[j]}, 1e-300)) + e.e{j}" for j in range(3)]

    def step(joint: list[str], source: str) -> str:
        return f"""SELECT symbol, bar_no, exp(j0 - m - ln(t)) AS p0, exp(j1 - m - ln(t)) AS p1, exp(j2 - m - ln(t)) AS p2, m + ln(t) AS step_ll FROM (
    SELECT *, exp(j0 - m) + exp(j1 - m) + exp(j2 - m) AS t FROM (SELECT *, greatest(j0, j1, j2) AS m FROM (
      SELECT e.symbol, e.bar_no, {", ".join(f"{x} AS j{i}" for i, x in enumerate(joint))} FROM {source})))"""

    return f"""{FEATURES}, emitted AS (
  SELECT symbol, ts, bar_no, {", ".join(f"{_log_density(i)} AS e{i}" for i in range(3))} FROM features
), forward AS (
  {step(weigh(first), "emitted e WHERE e.bar_no = 0")}
  UNION ALL
  {step(weigh(later), "forward f JOIN emitted e ON e.symbol = f.symbol AND e.bar_no = f.bar_no + 1")}
), scored AS (
  SELECT x.*, f.p0, f.p1, f.p2, f.step_ll, greatest(f.p0, f.p1, f.p2) AS confidence,
    CASE WHEN f.p0 >= f.p1 AND f.p0 >= f.p2 THEN 0 WHEN f.p1 >= f.p2 THEN 1 ELSE 2 END::INTEGER AS state
  FROM features x JOIN forward f USING (symbol, bar_no))"""


SCORED = _recursive_scores()
RECENT = f"""{SCORED}, recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_no DESC) AS rn FROM scored) WHERE rn <= 500)"""
QUOTED = f"""{TICKS}, quoted AS (
  SELECT * FROM (SELECT *, last_value(CASE WHEN kind = 'B' THEN price END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN kind = 'A' THEN price END IGNORE NULLS) OVER w AS ask
    FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) WHERE kind = 'L'
), sided AS (
  SELECT *, CASE WHEN price >= ask THEN volume WHEN price <= bid THEN 0.0 ELSE volume / 2 END AS buy_vol,
    CASE WHEN price >= ask THEN 0.0 WHEN price <= bid THEN volume ELSE volume / 2 END AS sell_vol
  FROM quoted WHERE volume > 0
), flow AS (
  SELECT *, buy_vol - sell_vol AS delta, buy_vol + sell_vol AS total, CASE WHEN buy_vol + sell_vol > 0 THEN (buy_vol - sell_vol) / (buy_vol + sell_vol) ELSE 0.0 END AS imbalance
  FROM (SELECT symbol, date_trunc('hour', ts) AS ts, sum(buy_vol) AS buy_vol, sum(sell_vol) AS sell_vol FROM sided GROUP BY ALL)
), deltas AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts)::INTEGER AS n_deltas,
    CASE WHEN coalesce(stddev_samp(delta) OVER w, 0) > 1e-10 THEN (avg(delta) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) - avg(delta) OVER w) / stddev_samp(delta) OVER w ELSE 0.0 END AS delta_z
  FROM flow WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING))"""
TRADES = """trades AS (
  SELECT l_suppkey::VARCHAR AS account, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS trade_id, l_shipdate AS ts,
    CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * round(l_extendedprice * l_discount) / 100 AS pnl
  FROM lineitem)"""
DAILY = f"""{TRADES}, islands AS (
  SELECT *, ts::DATE AS day, sum(pnl) OVER w AS day_pnl, count(*) OVER w AS day_trades, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER w AS island
  FROM trades WINDOW w AS (PARTITION BY account, ts::DATE ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)
), daily AS (
  SELECT *, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY account, day, island ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)::BIGINT AS losses FROM islands)"""
CURVE = f"""{TRADES}, curve AS (SELECT *, sum(pnl) OVER (PARTITION BY account ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM trades)"""
PROFILES = """profiles(symbol, confidence_threshold, max_flips, stop_atr_mult, target_atr_mult, flatten_minutes, max_size, point_value) AS (VALUES
  ('NQ', 0.55, 6, 2.0, 3.0, 5, 2, 20.0), ('ES', 0.55, 6, 2.0, 3.0, 5, 4, 50.0), ('CL', 0.60, 5, 1.5, 2.5, 10, 2, 1000.0), ('NG', 0.60, 4, 1.5, 2.5, 10, 1, 10000.0),
  ('GC', 0.55, 5, 2.0, 3.0, 10, 2, 100.0), ('SI', 0.60, 4, 1.5, 2.5, 10, 1, 5000.0), ('ZB', 0.55, 5, 2.0, 3.0, 5, 2, 1000.0), ('UB', 0.55, 5, 2.0, 3.0, 5, 2, 1000.0))"""
PROFILED = f"""{SCORED}, {PROFILES}, named AS (
  SELECT symbol AS event_type, ['NQ', 'ES', 'CL', 'NG', 'GC', 'SI', 'ZB', 'UB'][row_number() OVER (ORDER BY symbol)] AS symbol FROM (SELECT DISTINCT symbol FROM scored)
), profiled AS (SELECT s.* EXCLUDE (symbol), n.symbol FROM scored s JOIN named n ON s.symbol = n.event_type)"""


_FEATURE_LIST = ", ".join(f"{_r6(f)} AS {f}" for f in NAMES)
_PLAIN_WINDOWED = f"""{RETURNS}, windowed AS (SELECT *, {_z("log_return", 100)} AS log_return_z, {_z("realised_vol", 100)} AS realised_vol_z,
  CASE WHEN bar_no = 0 THEN 0.0 ELSE least(greatest({_z("volume", 20)}, -3), 3) END AS volume_z FROM vols)"""
_QUALITY = f"""{BARS}, steps AS (
  SELECT *, epoch(ts) - lag(epoch(ts)) OVER w AS gap, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)
), limits AS (SELECT symbol, quantile_cont(gap, 0.5) AS med, avg(ret) AS m, stddev_samp(ret) AS s, count(*) AS n FROM steps GROUP BY symbol
), counts AS (
  SELECT s.symbol, count(*) AS n_bars, CASE WHEN count(*) < 200 THEN count(*) ELSE 0 END AS few_bars, count(ts) - count(DISTINCT ts) AS duplicate_timestamps,
    count_if(high < low) AS high_below_low, count_if(open > high) AS open_above_high, count_if(open < low) AS open_below_low,
    count_if(med > 0 AND gap > 3 * med) AS time_gaps, count_if(n > 20 AND l.s > 0 AND abs(ret - m) > 10 * l.s) AS return_outliers, count_if(close <= 0) AS close_not_positive
  FROM steps s JOIN limits l ON s.symbol = l.symbol GROUP BY s.symbol
), listed AS (
  SELECT symbol, n_bars, unnest(['few_bars', 'duplicate_timestamps', 'high_below_low', 'open_above_high', 'open_below_low', 'time_gaps', 'return_outliers', 'close_not_positive']) AS "check",
    unnest([few_bars, duplicate_timestamps, high_below_low, open_above_high, open_below_low, time_gaps, return_outliers, close_not_positive])::BIGINT AS n,
    unnest(range(8)) AS place
  FROM counts)"""
_OCCUPANCY = "(pow(count_if(state = 0) - count(*) / 3, 2) + pow(count_if(state = 1) - count(*) / 3, 2) + pow(count_if(state = 2) - count(*) / 3, 2)) / (count(*) / 3) / 3"
_TRANSITION = "[" + ", ".join("[" + ", ".join(map(str, row)) + "]" for row in SAMPLE_MODEL["transition_matrix"]) + "]"
_TRANSITIONS = f"""{RECENT}, moves AS (SELECT symbol, lag(state) OVER (PARTITION BY symbol ORDER BY bar_no) AS i, state AS j FROM recent
), grid AS (SELECT s.symbol, i, j, {_TRANSITION}[i + 1][j + 1] AS q FROM (SELECT DISTINCT symbol FROM recent) s, (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)
), cells AS (
  SELECT g.*, count(m.i) AS c FROM grid g LEFT JOIN moves m ON m.symbol = g.symbol AND m.i = g.i AND m.j = g.j GROUP BY ALL
), shares AS (
  SELECT symbol, q, least(greatest(CASE WHEN sum(c) OVER (PARTITION BY symbol, i) > 0 THEN c / sum(c) OVER (PARTITION BY symbol, i) ELSE 0 END, 1e-10), 1) AS p FROM cells
), moved AS (SELECT symbol, greatest(sum(p * ln(p / q)) / 3, 0) AS transition_drift FROM shares GROUP BY symbol)"""
_FEATURE_DRIFT_ROWS = " UNION ALL ".join(
    f"SELECT symbol, {i} AS place, '{f}' AS feature, 0.7 * abs(avg({f}) - {m}) / {s} + 0.3 * abs(ln(greatest(stddev_samp({f}), 1e-10) / {s})) AS drift FROM recent GROUP BY symbol"
    for i, (f, m, s) in enumerate(zip(NAMES, SAMPLE_MODEL["feature_mean"], SAMPLE_MODEL["feature_std"], strict=True))
)
_DECIDED = f"""{_TRANSITIONS}, drifts AS ({_FEATURE_DRIFT_ROWS}
), measures AS (
  SELECT symbol, count(*) AS n, round({_OCCUPANCY}, 4) AS occupancy_drift, round(least(greatest(-2.5 - avg(step_ll), 0) / 2.5, 1), 4) AS likelihood_drop FROM recent GROUP BY symbol
), reasons AS (
  SELECT m.symbol, m.n, m.n >= 100 AS ready, m.occupancy_drift, CASE WHEN m.n >= 100 THEN concat_ws(',', CASE WHEN occupancy_drift > 0.3 THEN 'occupancy' END, CASE WHEN round(t.transition_drift, 4) > 0.5 THEN 'transition' END,
    CASE WHEN likelihood_drop > 0.2 THEN 'likelihood' END, (SELECT 'feature:' || arg_min(feature, place) FROM drifts d WHERE d.symbol = m.symbol AND round(drift, 4) > 0.15)) ELSE '' END AS reasons
  FROM measures m JOIN moved t USING (symbol))"""
_RULES = f"""{WILDER}, averaged AS (
  SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 19 PRECEDING) AS sma_fast, avg(close) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 49 PRECEDING) AS sma_slow,
    quantile_cont(atr, 0.5) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 59 PRECEDING) AS q50, quantile_cont(atr, 0.75) OVER (PARTITION BY symbol ORDER BY bar_no ROWS 59 PRECEDING) AS q75 FROM smoothed
), ruled AS (
  SELECT *, CASE WHEN bar_no < 49 OR (atr < q50 AND abs(sma_fast - sma_slow) / greatest(sma_slow, 1e-10) < 0.002) THEN 0 WHEN atr >= q75 THEN 2 ELSE 1 END::INTEGER AS rule_state FROM averaged)"""
_HYSTERESIS = f"""{SCORED}, offered AS (SELECT symbol, ts, bar_no, session_id, CASE WHEN confidence >= 0.55 THEN state ELSE -1 END AS s FROM scored
), automaton AS (
  SELECT symbol, bar_no, session_id, s AS regime, s AS candidate, CASE WHEN s >= 0 THEN 3 ELSE 0 END AS dwell, 0 AS flips FROM offered WHERE bar_no = 0
  UNION ALL
  SELECT symbol, bar_no, session_id, CASE WHEN kind = 'start' OR kind = 'switch' THEN s ELSE regime END, CASE WHEN kind = 'hold' THEN candidate ELSE s END,
    CASE kind WHEN 'hold' THEN dwell WHEN 'start' THEN 3 WHEN 'same' THEN 0 WHEN 'switch' THEN 0 WHEN 'again' THEN dwell + 1 ELSE 1 END, CASE WHEN kind = 'switch' THEN flips + 1 ELSE flips END
  FROM (SELECT *, CASE WHEN s < 0 OR flips >= 6 THEN 'hold' WHEN regime < 0 THEN 'start' WHEN s = regime THEN 'same' WHEN s = candidate AND dwell + 1 >= 3 THEN 'switch' WHEN s = candidate THEN 'again' ELSE 'other' END AS kind
    FROM (SELECT o.symbol, o.bar_no, o.session_id, o.s, a.regime, a.candidate, a.dwell, CASE WHEN o.session_id <> a.session_id THEN 0 ELSE a.flips END AS flips
      FROM automaton a JOIN offered o ON o.symbol = a.symbol AND o.bar_no = a.bar_no + 1))
), decided AS (SELECT o.symbol, o.ts, o.bar_no, a.regime::INTEGER AS regime, a.flips::INTEGER AS flips FROM offered o JOIN automaton a USING (symbol, bar_no))"""
_SIGNAL = "CASE WHEN regime <= 0 THEN 0 WHEN regime = 1 THEN CASE WHEN log_return_z > 0.5 THEN 1 WHEN log_return_z < -0.5 THEN -1 ELSE 0 END ELSE CASE WHEN rsi_deviation < -0.4 THEN 1 WHEN rsi_deviation > 0.4 THEN -1 ELSE 0 END END"


def _confirmation(signal: str, z: str, i: str, n: str, dt: float, it: float = 0.15) -> str:
    return f"""CASE WHEN {signal} = 0 OR {n} < 5 THEN 'neutral' WHEN ({z} * {signal} > {dt} AND NOT {i} * {signal} < -{it}) OR ({i} * {signal} > {it} AND NOT {z} * {signal} < -{dt}) THEN 'confirm'
    WHEN {z} * {signal} < -{dt} AND {i} * {signal} < -{it} THEN 'deny' ELSE 'neutral' END"""


_VITERBI_MOVE = lambda j, v: "greatest(" + ", ".join(f"{v}.v{i} + ln({SAMPLE_MODEL['transition_matrix'][i][j]})" for i in range(3)) + ")"
_CAME = lambda j: "CASE " + " ".join(f"WHEN v.v{i} + ln({SAMPLE_MODEL['transition_matrix'][i][j]}) = {_VITERBI_MOVE(j, 'v')} THEN {i}" for i in range(3)) + " END"
_VITERBI = f"""{FEATURES}, emitted AS (SELECT symbol, ts, bar_no, {", ".join(f"{_log_density(i)} AS e{i}" for i in range(3))} FROM features
), best AS (
  SELECT symbol, bar_no, {", ".join(f"ln({SAMPLE_MODEL['initial_probs'][i]}) + e{i} AS v{i}" for i in range(3))}, 0 AS b0, 0 AS b1, 0 AS b2 FROM emitted WHERE bar_no = 0
  UNION ALL
  SELECT e.symbol, e.bar_no, {", ".join(f"{_VITERBI_MOVE(j, 'v')} + e.e{j}" for j in range(3))}, {", ".join(_CAME(j) for j in range(3))} FROM best v JOIN emitted e ON e.symbol = v.symbol AND e.bar_no = v.bar_no + 1
), path AS (
  SELECT symbol, bar_no, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS state FROM best QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_no DESC) = 1
  UNION ALL
  SELECT b.symbol, b.bar_no - 1, CASE p.state WHEN 0 THEN b.b0 WHEN 1 THEN b.b1 ELSE b.b2 END FROM path p JOIN best b ON b.symbol = p.symbol AND b.bar_no = p.bar_no WHERE b.bar_no > 0
)"""


def _own_models(versions: list[tuple]) -> str:
    """Emissions and parameters of every bar under its symbol's model in force, numbered anew under each; two states have a third out of reach."""
    columns = [f"i{i}" for i in range(3)] + [f"a{i}{j}" for i in range(3) for j in range(3)] + [f"m{i}{f}" for i in range(3) for f in range(6)] + [f"v{i}{f}" for i in range(3) for f in range(6)]
    rows = []
    for symbol, version, start, model in versions:
        k = model["k"]
        later = [s for y, _, s, _ in versions if y == symbol and s and (start is None or s > start)]
        pad = lambda rows, width, fill, k=k: [[*row, *[fill] * (width - len(row))] for row in rows] + [[fill] * width] * (3 - k)
        numbers = [*pad([model["initial_probs"]], 3, 0.0, 3)[0], *(x for row in pad(model["transition_matrix"], 3, 0.0) for x in row), *(x for row in pad(model["means"], 6, 0.0) for x in row), *(x for row in pad(model["variances"], 6, 1.0) for x in row)]
        span = ", ".join(f"TIMESTAMP '{t}'" if t else "NULL::TIMESTAMP" for t in (start, min(later, default=None)))
        rows.append(f"('{symbol}', '{version}', {span}, {k}, {', '.join(f'{float(x)!r}::DOUBLE' for x in numbers)})")
    density = lambda i: "-0.5 * (6 * ln(2 * pi()) + " + " + ".join(f"ln(v{i}{f}) + ({x} - m{i}{f}) * ({x} - m{i}{f}) / v{i}{f}" for f, x in enumerate(NAMES)) + ")"
    return f"""{FEATURES}, models(symbol, model_version, since, until, k, {", ".join(columns)}) AS (VALUES {", ".join(rows)}), emitted AS (
  SELECT f.symbol, ts, model_version, row_number() OVER (PARTITION BY f.symbol, model_version ORDER BY bar_no) - 1 AS n, {", ".join(columns[:12])},
    {density(0)} AS e0, {density(1)} AS e1, CASE WHEN k = 3 THEN {density(2)} ELSE -1e300 END AS e2
  FROM features f JOIN models m ON m.symbol = f.symbol AND (since IS NULL OR ts >= since) AND (until IS NULL OR ts < until))"""


def _filtered_by_own(versions: list[tuple]) -> str:
    joint = lambda q, e: [f"ln(greatest({' + '.join(f'{q}{i} * {e}a{i}{j}' for i in range(3))}, 1e-300)) + {e}e{j}" for j in range(3)]

    def step(joint: list[str], source: str) -> str:
        return f"""SELECT symbol, model_version, n, exp(j0 - m - ln(t)) AS p0, exp(j1 - m - ln(t)) AS p1, exp(j2 - m - ln(t)) AS p2, m + ln(t) AS step_ll FROM (
    SELECT *, exp(j0 - m) + exp(j1 - m) + exp(j2 - m) AS t FROM (SELECT *, greatest(j0, j1, j2) AS m FROM (
      SELECT e.symbol, e.model_version, e.n, {", ".join(f"{x} AS j{i}" for i, x in enumerate(joint))} FROM {source})))"""

    return f"""{_own_models(versions)}, forward AS (
  {step(joint("e.i", "e."), "emitted e WHERE e.n = 0")}
  UNION ALL
  {step(joint("f.p", "e."), "forward f JOIN emitted e ON e.symbol = f.symbol AND e.model_version = f.model_version AND e.n = f.n + 1")}
), scored AS (
  SELECT e.ts, f.*, greatest(f.p0, f.p1, f.p2) AS confidence, CASE WHEN f.p0 >= f.p1 AND f.p0 >= f.p2 THEN 0 WHEN f.p1 >= f.p2 THEN 1 ELSE 2 END::INTEGER AS state
  FROM emitted e JOIN forward f USING (symbol, model_version, n))"""


def _path_by_own(versions: list[tuple]) -> str:
    way = lambda i, j: f"v.v{i} + ln(greatest(e.a{i}{j}, 1e-300))"
    most = lambda j: f"greatest({', '.join(way(i, j) for i in range(3))})"
    came = lambda j: "CASE " + " ".join(f"WHEN {way(i, j)} = {most(j)} THEN {i}" for i in range(3)) + " END"
    return f"""{_own_models(versions)}, best AS (
  SELECT symbol, model_version, n, {", ".join(f"ln(greatest(i{i}, 1e-300)) + e{i} AS v{i}" for i in range(3))}, 0 AS b0, 0 AS b1, 0 AS b2 FROM emitted WHERE n = 0
  UNION ALL
  SELECT e.symbol, e.model_version, e.n, {", ".join(f"{most(j)} + e.e{j}" for j in range(3))}, {", ".join(came(j) for j in range(3))}
  FROM best v JOIN emitted e ON e.symbol = v.symbol AND e.model_version = v.model_version AND e.n = v.n + 1
), path AS (
  SELECT symbol, model_version, n, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS state FROM best QUALIFY row_number() OVER (PARTITION BY symbol, model_version ORDER BY n DESC) = 1
  UNION ALL
  SELECT b.symbol, b.model_version, b.n - 1, CASE p.state WHEN 0 THEN b.b0 WHEN 1 THEN b.b1 ELSE b.b2 END FROM path p JOIN best b ON b.symbol = p.symbol AND b.model_version = p.model_version AND b.n = p.n WHERE b.n > 0
)"""


def _judged(train: int, test: int, step: int) -> str:
    """The test part of every window that fits, filtered and decoded under the sample model from its own first bar."""
    p, a = SAMPLE_MODEL["initial_probs"], SAMPLE_MODEL["transition_matrix"]
    later = [" + ".join(f"f.p{i} * {a[i][j]}" for i in range(3)) for j in range(3)]

    def forward(prediction: list, source: str) -> str:
        return f"""SELECT symbol, window_idx, n, exp(j0 - m - ln(t)) AS p0, exp(j1 - m - ln(t)) AS p1, exp(j2 - m - ln(t)) AS p2, m + ln(t) AS step_ll FROM (
    SELECT *, exp(j0 - m) + exp(j1 - m) + exp(j2 - m) AS t FROM (SELECT *, greatest(j0, j1, j2) AS m FROM (
      SELECT e.symbol, e.window_idx, e.n, {", ".join(f"ln(greatest({x}, 1e-300)) + e.e{i} AS j{i}" for i, x in enumerate(prediction))} FROM {source})))"""

    return f"""{FEATURES}, plan AS (
  SELECT symbol, i::INTEGER AS window_idx, i * {step} AS start, i * {step} + {train} AS train_end, i * {step} + {train + test} AS test_end
  FROM (SELECT symbol, unnest(range((count(*) - {train + test}) // {step} + 1)) AS i FROM features GROUP BY symbol HAVING count(*) >= {train + test})
), emitted AS (
  SELECT f.symbol, window_idx, bar_no - train_end AS n, {", ".join(f"{_log_density(i)} AS e{i}" for i in range(3))} FROM features f JOIN plan w ON w.symbol = f.symbol AND bar_no >= train_end AND bar_no < test_end
), forward AS (
  {forward(p, "emitted e WHERE e.n = 0")}
  UNION ALL
  {forward(later, "forward f JOIN emitted e ON e.symbol = f.symbol AND e.window_idx = f.window_idx AND e.n = f.n + 1")}
), best AS (
  SELECT symbol, window_idx, n, {", ".join(f"ln({p[i]}) + e{i} AS v{i}" for i in range(3))}, 0 AS b0, 0 AS b1, 0 AS b2 FROM emitted WHERE n = 0
  UNION ALL
  SELECT e.symbol, e.window_idx, e.n, {", ".join(f"{_VITERBI_MOVE(j, 'v')} + e.e{j}" for j in range(3))}, {", ".join(_CAME(j) for j in range(3))} FROM best v JOIN emitted e ON e.symbol = v.symbol AND e.window_idx = v.window_idx AND e.n = v.n + 1
), path AS (
  SELECT symbol, window_idx, n, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS state FROM best QUALIFY row_number() OVER (PARTITION BY symbol, window_idx ORDER BY n DESC) = 1
  UNION ALL
  SELECT b.symbol, b.window_idx, b.n - 1, CASE p.state WHEN 0 THEN b.b0 WHEN 1 THEN b.b1 ELSE b.b2 END FROM path p JOIN best b ON b.symbol = p.symbol AND b.window_idx = p.window_idx AND b.n = p.n WHERE b.n > 0
), same AS (SELECT *, (state = lag(state) OVER (PARTITION BY symbol, window_idx ORDER BY n))::INTEGER AS same FROM path
), stable AS (SELECT symbol, window_idx, coalesce(avg(same), 1) AS stability FROM same GROUP BY ALL
), counted AS (SELECT symbol, window_idx, state, count(*) AS c FROM path GROUP BY ALL
), top AS (SELECT symbol, window_idx, state::INTEGER AS dominant_state FROM counted QUALIFY row_number() OVER (PARTITION BY symbol, window_idx ORDER BY c DESC, state) = 1
), likely AS (SELECT symbol, window_idx, sum(step_ll) AS test_ll FROM forward GROUP BY ALL
), judged AS (SELECT * FROM plan JOIN likely USING (symbol, window_idx) JOIN stable USING (symbol, window_idx) JOIN top USING (symbol, window_idx))"""


def _rolling_drift(window: int) -> str:
    """The drift measures of the last rows at every row, by frames."""
    q, mean, std = (SAMPLE_MODEL[c] for c in ("transition_matrix", "feature_mean", "feature_std"))
    sums = [f"sum((state = {i})::INTEGER) OVER w AS c{i}" for i in range(3)] + [f"coalesce(sum((before = {i} AND state = {j})::INTEGER) OVER v, 0) AS m{i}{j}" for i in range(3) for j in range(3)]
    sums += [f"avg({x}) OVER w AS mean{c}, stddev_samp({x}) OVER w AS std{c}" for c, x in enumerate(NAMES)]
    share = lambda i, j: f"least(greatest(CASE WHEN m{i}0 + m{i}1 + m{i}2 > 0 THEN m{i}{j} / (m{i}0 + m{i}1 + m{i}2) ELSE 0.0 END, 1e-10), 1)"
    moved = " + ".join(f"{share(i, j)} * ln({share(i, j)} / {q[i][j]})" for i in range(3) for j in range(3))
    drifts = [f"round(CASE WHEN n < 30 THEN 0 ELSE 0.7 * abs(mean{c} - {mean[c]}) / {std[c]} + 0.3 * abs(ln(greatest(coalesce(std{c}, 0), 1e-10) / {std[c]})) END, 4) AS f{c}" for c in range(6)]
    first = "CASE " + " ".join(f"WHEN f{c} > 0.15 THEN 'feature:{x}'" for c, x in enumerate(NAMES)) + " END"
    return f"""{SCORED}, slid AS (
  SELECT symbol, ts, count(*) OVER w AS n, avg(step_ll) OVER w AS mean_ll, {", ".join(sums)} FROM (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY bar_no) AS before FROM scored)
  WINDOW w AS (PARTITION BY symbol ORDER BY bar_no ROWS {window - 1} PRECEDING), v AS (PARTITION BY symbol ORDER BY bar_no ROWS {window - 2} PRECEDING)
), measured AS (
  SELECT symbol, ts, n, n >= 100 AS ready, round((pow(c0 - n / 3, 2) + pow(c1 - n / 3, 2) + pow(c2 - n / 3, 2)) / (n / 3) / 3, 4) AS occupancy_drift,
    round(CASE WHEN n < 10 THEN 0.0 ELSE greatest(({moved}) / 3, 0) END, 4) AS transition_drift, round(least(greatest((-2.5 - mean_ll) / 2.5, 0), 1), 4) AS likelihood_drop, {", ".join(drifts)}
  FROM slid
), told AS (
  SELECT *, CASE WHEN ready THEN concat_ws(',', CASE WHEN occupancy_drift > 0.3 THEN 'occupancy' END, CASE WHEN transition_drift > 0.5 THEN 'transition' END, CASE WHEN likelihood_drop > 0.2 THEN 'likelihood' END, {first}) ELSE '' END AS reasons FROM measured)"""


def _em_step() -> str:
    """Forward and backward recursions over all bars from the sample model, and the parameters that their posteriors give."""
    p, a = SAMPLE_MODEL["initial_probs"], SAMPLE_MODEL["transition_matrix"]
    later = [" + ".join(f"f.a{i} * {a[i][j]}" for i in range(3)) for j in range(3)]
    back = [" + ".join(f"{a[i][j]} * exp(e.e{j} - greatest(e.e0, e.e1, e.e2)) * b.b{j}" for j in range(3)) for i in range(3)]

    def forward(prediction: list, source: str) -> str:
        return f"""SELECT symbol, bar_no, {", ".join(f"w{i} / (w0 + w1 + w2) AS a{i}" for i in range(3))}, m + ln(w0 + w1 + w2) AS ll FROM (
    SELECT e.symbol, e.bar_no, greatest(e.e0, e.e1, e.e2) AS m, {", ".join(f"({x}) * exp(e.e{i} - greatest(e.e0, e.e1, e.e2)) AS w{i}" for i, x in enumerate(prediction))} FROM {source})"""

    moves = [f"f.a{i} * {a[i][j]} * exp(e.e{j} - greatest(e.e0, e.e1, e.e2)) * b.b{j} AS x{i}{j}" for i in range(3) for j in range(3)]
    total = " + ".join(f"x{i}{j}" for i in range(3) for j in range(3))
    per_state = []
    for i in range(3):
        row = " + ".join(f"n{i}{j} + 1e-12" for j in range(3))
        means = [f"s{i}{c} / greatest(g{i}, 1e-12)" for c in range(6)]
        spread = [f"greatest(q{i}{c} / greatest(g{i}, 1e-12) - pow({means[c]}, 2), 1e-6)" for c in range(6)]
        cells = [f"{_r6(f'first{i}')} AS initial_prob", *(f"{_r6(f'(n{i}{j} + 1e-12) / ({row})')} AS move_{j}" for j in range(3)), *(f"{_r6(m)} AS mean_{c}" for c, m in enumerate(means)), *(f"{_r6(v)} AS variance_{c}" for c, v in enumerate(spread))]
        per_state.append(f"SELECT symbol, {i}::INTEGER AS state, round(ll, 3) AS log_likelihood, {', '.join(cells)} FROM sums JOIN moved USING (symbol)")
    return f"""{FEATURES}, emitted AS (SELECT symbol, bar_no, {", ".join(NAMES)}, {", ".join(f"{_log_density(i)} AS e{i}" for i in range(3))} FROM features
), ahead AS (
  {forward(p, "emitted e WHERE e.bar_no = 0")}
  UNION ALL
  {forward(later, "ahead f JOIN emitted e ON e.symbol = f.symbol AND e.bar_no = f.bar_no + 1")}
), behind AS (
  SELECT symbol, max(bar_no) AS bar_no, 1.0::DOUBLE AS b0, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM emitted GROUP BY symbol
  UNION ALL
  SELECT symbol, bar_no, {", ".join(f"v{i} / (v0 + v1 + v2)" for i in range(3))} FROM (
    SELECT e.symbol, e.bar_no - 1 AS bar_no, {", ".join(f"{x} AS v{i}" for i, x in enumerate(back))} FROM behind b JOIN emitted e ON e.symbol = b.symbol AND e.bar_no = b.bar_no WHERE e.bar_no > 0)
), post AS (
  SELECT e.*, f.ll, {", ".join(f"f.a{i} * b.b{i} / (f.a0 * b.b0 + f.a1 * b.b1 + f.a2 * b.b2) AS g{i}" for i in range(3))} FROM emitted e JOIN ahead f USING (symbol, bar_no) JOIN behind b USING (symbol, bar_no)
), sums AS (
  SELECT symbol, sum(ll) AS ll, {", ".join(f"sum(g{i}) AS g{i}, max(g{i}) FILTER (WHERE bar_no = 0) AS first{i}" for i in range(3))},
    {", ".join(f"sum(g{i} * {x}) AS s{i}{c}, sum(g{i} * {x} * {x}) AS q{i}{c}" for i in range(3) for c, x in enumerate(NAMES))}
  FROM post GROUP BY symbol
), moved AS (
  SELECT symbol, {", ".join(f"sum(x{i}{j} / ({total})) AS n{i}{j}" for i in range(3) for j in range(3))} FROM (
    SELECT e.symbol, {", ".join(moves)} FROM ahead f JOIN emitted e ON e.symbol = f.symbol AND e.bar_no = f.bar_no + 1 JOIN behind b ON b.symbol = e.symbol AND b.bar_no = e.bar_no) GROUP BY symbol
), stepped AS ({" UNION ALL ".join(per_state)})"""


def _mixed(x: str, out: str, source: str) -> str:
    """source with a column of 64 scattered bits: the two rounds of resample.mixed, in 128-bit numbers."""
    folds = ((1 << 30, 0xBF58476D1CE4E5B9), (1 << 27, 0x94D049BB133111EB))
    for fold, factor in folds:
        source = f"(SELECT *, xor({x}, {x} // {fold}::UHUGEINT) * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT AS {out}__{fold} FROM {source})"
        x = f"{out}__{fold}"
    return f"(SELECT *, xor({x}, {x} // {1 << 31}::UHUGEINT) AS {out} FROM {source})"


def _simulated(n_sims: int, skip: float, slippage: float, seed: int) -> str:
    """Every trade in every simulation with its draws; then sums and runs in the drawn order, as resample.simulated has them."""
    whole = "18446744073709551616::UHUGEINT"
    source = f"""(SELECT account, pnl, h, n, place, sim FROM (
    SELECT *, count(*) OVER (PARTITION BY account) AS n, row_number() OVER (PARTITION BY account ORDER BY CASE WHEN h >= 9223372036854775808::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END, pnl) - 1 AS place
    FROM (SELECT *, ('0x' || md5(account || ':' || trade_id)[1:16])::UHUGEINT AS h FROM trades)), range({n_sims}) s(sim))"""
    for stream in range(4 if slippage else 2):
        source = _mixed(f"(sim * 4 + {stream + 1})::UHUGEINT", f"a{stream}", source)
        source = _mixed(f"((a{stream} + {seed}) % {whole})", f"b{stream}", source)
        source = _mixed(f"((b{stream} + h) % {whole})", f"d{stream}", source)
    uniform = lambda d: f"(({d} // 2048::UHUGEINT)::DOUBLE + 0.5) / 9007199254740992"
    noise = f" + {slippage} * sqrt(-2 * ln({uniform('d2')})) * cos(2 * pi() * {uniform('d3')})" if slippage else ""
    return f"""{TRADES}, drawn AS (
  SELECT account, sim, d0 // (pow(2, length(bin(greatest(n - 1, 1))))::UHUGEINT) AS high, place, pnl{noise} AS value, {uniform("d1")} >= {skip} AS kept FROM {source}
), ordered AS (
  SELECT *, CASE WHEN kept THEN value ELSE 0.0 END AS v, row_number() OVER (PARTITION BY account, sim ORDER BY high, place) AS i FROM drawn
), curves AS (
  SELECT *, sum(v) OVER w AS cum, count_if(v < 0) OVER w AS lost, count_if(kept) OVER w > 0 AS begun FROM ordered WINDOW w AS (PARTITION BY account, sim ORDER BY i ROWS UNBOUNDED PRECEDING)
), falls AS (
  SELECT *, max(CASE WHEN begun THEN cum END) OVER w - cum AS fall, lost - coalesce(max(CASE WHEN kept AND v >= 0 THEN lost END) OVER w, 0) AS run
  FROM curves WINDOW w AS (PARTITION BY account, sim ORDER BY i ROWS UNBOUNDED PRECEDING)
), simulated AS (
  SELECT account, sim::INTEGER AS sim, sum(v) AS final_pnl, coalesce(max(fall), 0) AS max_dd, max(run)::BIGINT AS max_losses FROM falls GROUP BY account, sim)"""


_FLOORED = [(symbol, "v1", None, LASTING) for symbol in ("click", "error", "purchase", "signup", "view")]
#: The risk engine one event after another: every value is what the engine holds after the event before.
_LIVE = """e AS (
  SELECT (o_custkey % 100)::VARCHAR AS account, date_trunc('quarter', o_orderdate) AS day, o_orderkey AS seq, ((o_orderkey % 7) - 3) * 10.0::DOUBLE AS pnl,
    ['signal', 'entry', 'exit', 'entry', 'exit', 'signal', 'stop', 'entry', 'exit', 'clear', 'exit'][o_orderkey % 11 + 1] AS kind FROM orders
), n AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY day, seq) AS i FROM e
), engine AS (
  SELECT account, 0::BIGINT AS i, 'idle' AS live, 0.0::DOUBLE AS total, 0 AS trades, 0::BIGINT AS run, NULL::DATE AS day FROM (SELECT DISTINCT account FROM e)
  UNION ALL
  SELECT account, i, CASE WHEN kind = 'stop' THEN 'emergency_stop' WHEN kind = 'clear' THEN 'idle' WHEN live = 'emergency_stop' THEN live
      WHEN kind = 'exit' THEN CASE WHEN total <= -40 OR total >= 50 OR run >= 2 THEN 'locked' WHEN trades >= 3 THEN 'halted' ELSE 'idle' END
      WHEN kind = 'signal' AND live = 'idle' THEN 'armed' WHEN kind = 'entry' AND live IN ('idle', 'armed') THEN 'in_trade' ELSE live END,
    total, CASE WHEN kind = 'entry' AND live IN ('idle', 'armed') THEN least(trades + 1, 3) ELSE trades END, run, day
  FROM (SELECT account, i, kind, live, trades, day, total + CASE WHEN kind = 'exit' THEN pnl ELSE 0 END AS total, CASE WHEN kind <> 'exit' THEN run WHEN pnl < 0 THEN run + 1 ELSE 0 END AS run
    FROM (SELECT n.account, n.i, n.kind, n.pnl, n.day::DATE AS day, fresh, g.live AS was, CASE WHEN fresh THEN 'idle' ELSE g.live END AS live, CASE WHEN fresh THEN 0.0 ELSE g.total END AS total,
        CASE WHEN fresh THEN 0 ELSE g.trades END AS trades, CASE WHEN fresh THEN 0 ELSE g.run END AS run
      FROM (SELECT g.*, n.day::DATE IS DISTINCT FROM g.day AND g.live <> 'emergency_stop' AS fresh FROM engine g JOIN n ON n.account = g.account AND n.i = g.i + 1) g
        JOIN n ON n.account = g.account AND n.i = g.i + 1)))"""

SQL = {
    "f6_features": f"WITH RECURSIVE {FEATURES} SELECT symbol, ts, bar_no, {_FEATURE_LIST}, bar_no >= 99 AS ready FROM features",
    "o0_hourly_bars": f"WITH {BARS} SELECT * FROM bars",
    "f0_log_return_z": f"WITH {_PLAIN_WINDOWED} SELECT symbol, ts, {_r6('log_return')} AS log_return, {_r6('log_return_z')} AS log_return_z FROM windowed",
    "f1_realised_vol_z": f"WITH {_PLAIN_WINDOWED} SELECT symbol, ts, {_r6('realised_vol')} AS realised_vol, {_r6('realised_vol_z')} AS realised_vol_z FROM windowed",
    "f5_volume_z": f"WITH {_PLAIN_WINDOWED} SELECT symbol, ts, {_r6('volume_z')} AS volume_z FROM windowed",
    "w1_rolling_stats": f"WITH {BARS} SELECT symbol, ts, {_r6('avg(close) OVER w')} AS mean20, {_r6('coalesce(stddev_samp(close) OVER w, 0)')} AS std20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)",
    "w2_z_score": f"WITH {BARS} SELECT symbol, ts, {_r6(_z('close', 50, 'ts'))} AS z50 FROM bars",
    "w3_rsi": f"WITH RECURSIVE {WILDER} SELECT symbol, ts, {_r6('rsi')} AS rsi, {_r6('(rsi - 50) / 50')} AS rsi_deviation FROM smoothed",
    "w4_atr": f"WITH RECURSIVE {WILDER} SELECT symbol, ts, {_r6('atr')} AS atr FROM smoothed",
    "w5_session_vwap": f"WITH {NUMBERED} SELECT symbol, ts, strftime(session_id, '%Y-%m-%d') AS session_id, round(sum((high + low + close) / 3 * volume) OVER w / greatest(sum(volume) OVER w, 1e-10), 9) AS vwap FROM numbered WINDOW w AS (PARTITION BY symbol, session_id ORDER BY ts)",
    "f6_features_by_halo": f"WITH RECURSIVE {FEATURES} SELECT symbol, ts, bar_no, {_FEATURE_LIST}, bar_no >= 99 AS ready FROM features",
    "f8_parity": "SELECT unnest([" + ", ".join(f"'{n}'" for n in NAMES) + "]) AS feature, count(*) > 0 AS within FROM events",
    "f6_features_never_reset": f"WITH RECURSIVE {_features('')} SELECT symbol, ts, {_r6('vwap_distance')} AS vwap_distance FROM features",
    "p_scalars": f"WITH {RETURNS} SELECT symbol, ts, {_r6('tr')} AS true_range, {_r6('(high + low + close) / 3')} AS typical_price, {_r6('least(greatest(coalesce(close - prev, 0), -1), 1)')} AS clipped, {_r6('gain')} AS gain, {_r6('loss')} AS loss FROM returns",
    "p13_percentile": f"WITH {TRADES} SELECT account, {_r6('quantile_cont(pnl, 0.05)')} AS p5, {_r6('quantile_cont(pnl, 0.5)')} AS p50, {_r6('quantile_cont(pnl, 0.95)')} AS p95 FROM trades GROUP BY account",
    "p15_profile_match": "SELECT o_orderkey, ['NQ', 'ES', 'CL', NULL][o_orderkey % 4 + 1] AS profile FROM orders",
    "s3_s4_clean_bars": f"""WITH {TICKS} SELECT symbol, seq, date_trunc('second', ts) AS ts, {_r6('price')} AS close, CASE WHEN seq % 17 = 5 THEN 0.0 ELSE volume END AS volume FROM ticks WHERE seq % 17 NOT IN (0, 1, 2, 3, 4)""",
    "s1_s8_bars_from_csv": f"""WITH {BARS}, named AS (SELECT symbol AS event_type, ['NQ', 'ES', 'CL', 'NG', 'GC', 'SI', 'ZB', 'UB'][row_number() OVER (ORDER BY symbol)] AS symbol FROM (SELECT DISTINCT symbol FROM bars))
      SELECT n.symbol, ts, {_r6('open')} AS open, {_r6('close')} AS close, volume FROM bars b JOIN named n ON b.symbol = n.event_type""",
    "s6_directory_of_bars": f"""WITH {BARS}, named AS (SELECT symbol AS event_type, ['NQ', 'ES', 'CL', 'NG', 'GC', 'SI', 'ZB', 'UB'][row_number() OVER (ORDER BY symbol)] AS symbol FROM (SELECT DISTINCT symbol FROM bars))
      SELECT n.symbol, ts, {", ".join(f"{_r6(c)} AS {c}" for c in ("open", "high", "low", "close"))}, volume FROM bars b JOIN named n ON b.symbol = n.event_type WHERE ts >= '2024-01-03'""",
    "s7_ingested_exports": f"""WITH {_QUALITY}, named AS (SELECT symbol AS event_type, ['NQ', 'ES', 'CL', 'NG', 'GC', 'SI', 'ZB', 'UB'][row_number() OVER (ORDER BY symbol)] AS symbol FROM (SELECT DISTINCT symbol FROM bars)), w AS (SELECT symbol, string_agg("check" || '=' || n, ',' ORDER BY "check" || '=' || n) AS warnings FROM listed WHERE n > 0 GROUP BY symbol)
      SELECT n.symbol, count(*) AS n_bars, {_r6('sum(close)')} AS close, coalesce(any_value(warnings), '') AS warnings FROM bars b JOIN named n ON b.symbol = n.event_type LEFT JOIN w ON w.symbol = b.symbol GROUP BY n.symbol""",
    "s9_trades_from_text": f"""WITH {TRADES} SELECT 'default' AS account, count(*) FILTER (WHERE trade_id % 11 > 2) AS n, round(sum(pnl) FILTER (WHERE trade_id % 11 > 2), 2) AS pnl, count(*) FILTER (WHERE trade_id % 11 = 2) AS rejected FROM trades""",
    "s10_s12_model_files": """SELECT ['NQ', 'ES', 'CL', 'NG', 'GC', 'SI', 'ZB', 'UB'][p_partkey % 9 + 1] AS symbol, lpad(max(p_partkey)::VARCHAR, 9, '0') AS trained_at, 3 AS k FROM part WHERE p_partkey % 9 < 8 GROUP BY 1""",
    "s13_s14_p17_messages": f"""WITH {BARS} SELECT CASE WHEN hour(ts) = 0 THEN 'none' ELSE symbol END AS symbol, sum(CASE WHEN hour(ts) BETWEEN 1 AND 5 THEN 2 ELSE 1 END)::BIGINT AS n,
      CASE WHEN max(hour(ts)) = 0 THEN -1 ELSE 2 END AS size FROM bars GROUP BY 1""",
    "s15_ticks": f"""WITH {TICKS} SELECT CASE WHEN seq % 13 = 0 OR seq % 17 = 0 OR NOT price > 0 THEN 'rejected' ELSE kind END AS kind, count(*) AS n FROM ticks GROUP BY 1""",
    "s5_bar_numbers": f"WITH {NUMBERED} SELECT symbol, ts, bar_no FROM numbered",
    "v_quality": f'WITH {_QUALITY} SELECT symbol, "check", n FROM listed WHERE n > 0',
    "v8_report": f"""WITH {_QUALITY} SELECT symbol, n_bars, count_if(n > 0) = 0 AS clean, coalesce(string_agg("check", ',' ORDER BY place) FILTER (WHERE n > 0), '') AS issues FROM listed GROUP BY symbol, n_bars""",
    "v9_training_status": f"""WITH {NUMBERED}, n AS (SELECT symbol, count(*) AS n_bars, count_if(bar_no >= 100)::BIGINT AS n_trainable FROM numbered GROUP BY symbol)
      SELECT *, CASE WHEN n_bars < 500 THEN 'too_few_bars' WHEN n_trainable < 500 THEN 'too_few_after_warm_up' ELSE 'ok' END AS status FROM n""",
    "m9_train_all": f"""WITH {NUMBERED}, n AS (SELECT symbol, count(*) AS n_bars, count_if(bar_no >= 100)::BIGINT AS n_trainable FROM numbered GROUP BY symbol),
      s AS (SELECT *, CASE WHEN n_bars < 500 THEN 'too_few_bars' WHEN n_trainable < 500 THEN 'too_few_after_warm_up' ELSE 'ok' END AS status FROM n) SELECT *, status = 'ok' AS trained FROM s""",
    "m1_emissions": f"WITH RECURSIVE {FEATURES} SELECT symbol, ts, {', '.join(f'{_r6(_log_density(i))} AS state_{i}' for i in range(3))} FROM features",
    "m1_emissions_by_model_table": f"WITH RECURSIVE {FEATURES} SELECT symbol, ts, {', '.join(f'{_r6(_log_density(i))} AS state_{i}' for i in range(3))} FROM features",
    "m2_forward_filter": f"WITH RECURSIVE {SCORED} SELECT symbol, ts, {_r6('p0')} AS p0, {_r6('p1')} AS p1, {_r6('p2')} AS p2, state, {_r6('confidence')} AS confidence, {_r6('step_ll')} AS step_ll FROM scored",
    "m2_by_model_table": f"WITH RECURSIVE {_filtered_by_own(VERSIONS)} SELECT symbol, ts, model_version, {_r6('p0')} AS p0, {_r6('p1')} AS p1, {_r6('p2')} AS p2, state, {_r6('confidence')} AS confidence, {_r6('step_ll')} AS step_ll FROM scored",
    "m4_filter_floor": f"WITH RECURSIVE {_filtered_by_own(_FLOORED)} SELECT symbol, ts, {_r6('p0')} AS p0, {_r6('p1')} AS p1, {_r6('p2')} AS p2, state, {_r6('step_ll')} AS step_ll FROM scored",
    "m5_by_model_table": f"WITH RECURSIVE {_path_by_own(VERSIONS)} SELECT symbol, ts, model_version, state::INTEGER AS state FROM path JOIN emitted USING (symbol, model_version, n)",
    "m10_scoring_by_model_table": f"WITH RECURSIVE {_filtered_by_own(VERSIONS)} SELECT symbol, ts, model_version, state, round(round(confidence, 6), 6) + 0.0 AS confidence FROM scored",
    "m6_em_step": f"WITH RECURSIVE {_em_step()} SELECT * FROM stepped",
    "r1_few_simulations": f"WITH {_simulated(5, 0.1, 0.0, 42)} SELECT account, sim, round(final_pnl, 2) AS final_pnl, round(max_dd, 2) AS max_dd, max_losses FROM simulated",
    "r1_few_with_slippage": f"WITH {_simulated(3, 0.05, 20.0, 7)} SELECT account, sim, round(final_pnl, 4) AS final_pnl, round(max_dd, 4) AS max_dd, max_losses FROM simulated",
    "r5_few_simulations": f"WITH {_simulated(12, 0.0, 0.0, 42)} SELECT account, count(*) AS n_sims, {_r6('avg(final_pnl)')} AS mean_pnl, {_r6('quantile_cont(final_pnl, 0.05)')} AS p5_pnl, {_r6('quantile_cont(final_pnl, 0.5)')} AS median_pnl, {_r6('quantile_cont(final_pnl, 0.95)')} AS p95_pnl, {_r6('avg(max_dd)')} AS mean_dd, {_r6('quantile_cont(max_dd, 0.05)')} AS p5_dd, {_r6('quantile_cont(max_dd, 0.5)')} AS median_dd, {_r6('quantile_cont(max_dd, 0.95)')} AS p95_dd, max(max_losses) AS max_losses, {_r6('avg((final_pnl > 500 AND max_dd < 400)::INTEGER)')} AS pass_rate FROM simulated GROUP BY account",
    "d1_rolling_drift": f"WITH RECURSIVE {_rolling_drift(200)} SELECT symbol, ts, n, ready, occupancy_drift, transition_drift, likelihood_drop, reasons <> '' AS retrain, reasons FROM told",
    "x3_windows_of_a_given_model": f"WITH RECURSIVE {_judged(90, 60, 30)} SELECT symbol, window_idx, start, train_end, test_end, round(test_ll, 3) AS test_ll, {_r6('stability')} AS stability, dominant_state, ['low_vol', 'trending', 'high_vol'][dominant_state + 1] AS dominant_regime FROM judged",
    "x6_summary_of_a_given_model": f"WITH RECURSIVE {_judged(90, 60, 30)} SELECT symbol, round(avg(test_ll), 3) AS mean_test_ll, {_r6('avg(stability)')} AS mean_stability, count(*) AS n_windows FROM judged GROUP BY symbol",
    "f9_streamed_features": f"WITH RECURSIVE {FEATURES} SELECT symbol, ts, {_FEATURE_LIST}, bar_no >= 99 AS ready FROM features",
    "m11_streamed_scores": f"WITH RECURSIVE {SCORED} SELECT symbol, ts, {_r6('p0')} AS p0, {_r6('p1')} AS p1, {_r6('p2')} AS p2, state, {_r6('step_ll')} AS step_ll FROM scored",
    "t1_streamed_regimes": f"WITH RECURSIVE {_HYSTERESIS} SELECT symbol, ts, regime, flips FROM decided",
    "d9_streamed_drift": f"WITH RECURSIVE {_rolling_drift(200)} SELECT symbol, ts, n, ready, occupancy_drift, transition_drift, likelihood_drop, reasons <> '' AS retrain, reasons FROM told",
    "m3_log_likelihood": f"WITH RECURSIVE {SCORED} SELECT symbol, round(sum(step_ll), 3) AS log_likelihood, count(*) AS n_bars FROM scored GROUP BY symbol",
    "m5_viterbi": f"WITH RECURSIVE {_VITERBI} SELECT symbol, ts, state::INTEGER AS state FROM path JOIN emitted USING (symbol, bar_no)",
    "m8_validation": """SELECT CASE p_size WHEN 1 THEN 'schema version 99' WHEN 2 THEN 'unknown symbol: INVALID' WHEN 3 THEN 'initial_probs has the wrong length' WHEN 4 THEN 'means has the wrong shape'
      WHEN 5 THEN 'missing field: feature_mean' END AS error, count(*) AS n FROM part GROUP BY 1""",
    "m10_request_errors": f"""WITH {BARS} SELECT CASE hour(ts) % 10 WHEN 0 THEN 'INVALID_REQUEST' WHEN 1 THEN 'MODEL_NOT_FOUND' WHEN 2 THEN 'INVALID_FEATURES' ELSE 'OK' END AS code, count(*) AS n FROM bars GROUP BY 1""",
    "m10_batch_scoring": f"WITH RECURSIVE {SCORED} SELECT symbol, ts, state, round(confidence, 6) AS confidence FROM scored",
    "d2_occupancy": f"WITH RECURSIVE {RECENT} SELECT symbol, {_r6(_OCCUPANCY)} AS occupancy_drift FROM recent GROUP BY symbol",
    "d3_transition_drift": f"WITH RECURSIVE {_TRANSITIONS} SELECT symbol, {_r6('transition_drift')} AS transition_drift FROM moved",
    "d4_likelihood_drop": f"WITH RECURSIVE {RECENT} SELECT symbol, {_r6('least(greatest(-2.5 - avg(step_ll), 0) / 2.5, 1)')} AS likelihood_drop FROM recent GROUP BY symbol",
    "d5_feature_drift": f"WITH RECURSIVE {RECENT}, drifts AS ({_FEATURE_DRIFT_ROWS}) SELECT symbol, feature, {_r6('drift')} AS drift FROM drifts",
    "d7_retrain_decision": f"WITH RECURSIVE {_DECIDED} SELECT symbol, n, ready, occupancy_drift, reasons <> '' AS retrain, reasons FROM reasons",
    "d8_bars_to_retrain": f"WITH RECURSIVE {_DECIDED} SELECT symbol, count(*) AS n_bars FROM bars WHERE symbol IN (SELECT symbol FROM reasons WHERE reasons <> '') GROUP BY symbol",
    "r3_max_drawdown": f"WITH {CURVE} SELECT account, round(max(dd), 2) AS max_dd FROM (SELECT account, max(cum) OVER (PARTITION BY account ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) - cum AS dd FROM curve) GROUP BY account",
    "r4_losing_streak": f"""WITH {CURVE}, i AS (SELECT account, pnl, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY account ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS island FROM curve)
      SELECT account, max(n) AS max_losses FROM (SELECT account, island, count_if(pnl < 0)::BIGINT AS n FROM i GROUP BY ALL) GROUP BY account""",
    "o1_prevailing_quotes": f"WITH {QUOTED} SELECT symbol, seq, ts, price, bid, ask FROM quoted",
    "o2_trade_sides": f"WITH {QUOTED} SELECT symbol, seq, buy_vol, sell_vol FROM sided",
    "o3_streamed_flow": f"WITH {QUOTED} SELECT symbol, ts, buy_vol, sell_vol, {_r6('imbalance')} AS imbalance FROM flow JOIN (SELECT symbol, max(ts) AS latest FROM ticks GROUP BY symbol) USING (symbol) WHERE ts + INTERVAL 1 HOUR <= latest - INTERVAL 96 HOUR",
    "o3_bar_flow": f"WITH {QUOTED} SELECT symbol, ts, buy_vol, sell_vol, delta, total, {_r6('imbalance')} AS imbalance FROM flow",
    "o4_cumulative_delta": f"WITH {QUOTED} SELECT symbol, ts, sum(delta) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS cum_delta FROM flow",
    "o5_large_orders": f"""WITH {TICKS}, t AS (
      SELECT symbol, date_trunc('hour', ts) AS bar, list(volume) OVER w AS sizes, avg(volume) OVER w AS m, lead(date_trunc('hour', ts)) OVER (PARTITION BY symbol ORDER BY ts, seq) AS next_bar
      FROM ticks WHERE kind = 'L' AND volume > 0 WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS 199 PRECEDING))
      SELECT symbol, bar AS ts, (CASE WHEN len(sizes) >= 10 THEN len(list_filter(sizes, lambda v: v >= 3 * m)) ELSE 0 END)::INTEGER AS large_orders FROM t WHERE next_bar IS NULL OR next_bar <> bar""",
    "o6_bar_proxy": f"""WITH {QUOTED}, {BARS.removeprefix(TICKS + ", ")} SELECT b.symbol, b.ts, {_r6("coalesce(f.delta, CASE WHEN high > low THEN (close - open) / (high - low) ELSE 0 END * b.volume)")} AS delta,
      {_r6("coalesce(f.imbalance, CASE WHEN high > low THEN (close - open) / (high - low) ELSE 0 END)")} AS imbalance FROM bars b LEFT JOIN flow f ON f.symbol = b.symbol AND f.ts = b.ts AND hour(f.ts) < 12""",
    "o7_delta_z": f"WITH {QUOTED} SELECT symbol, ts, {_r6('delta_z')} AS delta_z, n_deltas FROM deltas",
    "o8_confirmation": f"WITH {QUOTED}, s AS (SELECT *, CASE WHEN hour(ts) % 2 = 0 THEN 1 ELSE -1 END AS signal FROM deltas) SELECT symbol, ts, signal, {_confirmation('signal', 'delta_z', 'imbalance', 'n_deltas', 0.5)} AS confirmation FROM s",
    "t1_hysteresis": f"WITH RECURSIVE {_HYSTERESIS} SELECT symbol, ts, regime, flips FROM decided",
    "t2_rule_based": f"""WITH RECURSIVE {_RULES} SELECT symbol, ts, round(sma_fast, 9) AS sma_fast, round(sma_slow, 9) AS sma_slow, rule_state, (CASE WHEN bar_no < 49 OR rule_state = 0 THEN 0
      WHEN rule_state = 1 THEN CASE WHEN sma_fast > sma_slow THEN 1 WHEN sma_fast < sma_slow THEN -1 ELSE 0 END ELSE CASE WHEN close < sma_slow * 0.995 THEN 1 WHEN close > sma_slow * 1.005 THEN -1 ELSE 0 END END)::INTEGER AS rule_signal FROM ruled""",
    "t4_signals": f"WITH RECURSIVE {SCORED}, r AS (SELECT *, state AS regime FROM scored) SELECT symbol, ts, regime, ['low_vol', 'trending', 'high_vol'][regime + 1] AS label, ({_SIGNAL})::INTEGER AS signal FROM r",
    "t5_source_priority": f"""WITH RECURSIVE {SCORED} SELECT symbol, CASE WHEN bar_no % 20 <= 5 THEN 'external' WHEN bar_no % 3 > 0 THEN 'model' ELSE 'rule' END AS source, count(*) AS n FROM scored GROUP BY ALL""",
    "t6_t7_stops_and_sizes": f"""WITH RECURSIVE {PROFILED}, s AS (
      SELECT p.symbol, ts, atr * stop_atr_mult * CASE state WHEN 0 THEN 0.75 WHEN 2 THEN 1.5 ELSE 1 END AS stop_distance, atr * target_atr_mult * CASE state WHEN 0 THEN 0.75 WHEN 2 THEN 1.25 ELSE 1 END AS target_distance, point_value, max_size
      FROM profiled p JOIN profiles USING (symbol))
      SELECT symbol, ts, {_r6("stop_distance")} AS stop_distance, {_r6("target_distance")} AS target_distance, greatest(1, least(CASE WHEN stop_distance * point_value > 0 THEN floor(100.0 / (stop_distance * point_value)) ELSE 1 END, max_size))::INTEGER AS size FROM s""",
    "t8_mode_overrides": f"""WITH RECURSIVE {PROFILED} SELECT p.symbol, greatest(confidence_threshold, 0.60)::DOUBLE AS confidence_threshold, least(max_flips, 4)::INTEGER AS max_flips, greatest(flatten_minutes, 15)::INTEGER AS flatten_minutes,
      count_if(confidence >= greatest(confidence_threshold, 0.60))::BIGINT AS n_confident FROM profiled p JOIN profiles USING (symbol) GROUP BY ALL""",
    "t9_session_id": f"WITH {BARS} SELECT symbol, ts, strftime(ts - INTERVAL 18 HOUR, '%Y-%m-%d') AS session_id FROM bars",
    "t10_flatten": f"WITH {TICKS} SELECT symbol, seq, seq % 2 = 0 AND (epoch(date_trunc('day', ts) + INTERVAL 17 HOUR) - epoch(ts)) / 60 <= 120 AS flatten FROM ticks",
    "t11_decisions": f"""WITH RECURSIVE {_HYSTERESIS}, {QUOTED.removeprefix(TICKS + ", ")}, signalled AS (SELECT d.symbol, d.ts, d.bar_no, d.regime, ({_SIGNAL})::INTEGER AS signal FROM decided d JOIN features f USING (symbol, bar_no)
      ), joined AS (SELECT s.*, coalesce(delta_z, 0) AS z, coalesce(imbalance, 0) AS imb, coalesce(n_deltas, 0) AS n FROM signalled s LEFT JOIN deltas USING (symbol, ts)
      ), gated AS (SELECT symbol, ts, signal, CASE WHEN bar_no < 100 THEN 'warm_up' WHEN hour(ts) = 16 THEN 'flatten' WHEN signal <> 0 AND {_confirmation('signal', 'z', 'imb', 'n', 1.5)} = 'deny' THEN 'order_flow'
        WHEN day(ts) = 13 THEN 'evaluation_lock' WHEN signal = 0 THEN 'no_signal' END AS gate FROM joined)
      SELECT symbol, ts, gate, CASE WHEN gate IS NULL THEN signal ELSE 0 END AS action FROM gated""",
    "k1_paired_fills": """WITH fills AS (
      SELECT o_custkey::VARCHAR AS account, ['NQ', 'ES', 'CL'][o_custkey % 3 + 1] AS symbol, o_orderdate AS ts, o_orderkey AS seq, CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE -1 END AS side, o_totalprice / 100 AS price, o_orderkey % 2 = 1 AS is_entry FROM orders
      ), e AS (SELECT *, last_value(CASE WHEN is_entry THEN price END IGNORE NULLS) OVER b AS ep, last_value(CASE WHEN is_entry THEN side END IGNORE NULLS) OVER b AS es, lag(is_entry) OVER (PARTITION BY account, symbol ORDER BY ts, seq) AS pe
        FROM fills WINDOW b AS (PARTITION BY account, symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT account, symbol, seq, round(CASE WHEN coalesce(pe, false) THEN coalesce((price - ep) * es * CASE symbol WHEN 'NQ' THEN 20.0 WHEN 'ES' THEN 50.0 ELSE 1000.0 END, 0) ELSE 0 END, 4) AS pnl FROM e WHERE NOT is_entry""",
    "k2_daily": f"WITH {DAILY} SELECT account, trade_id, ts, round(day_pnl, 2) AS day_pnl, day_trades, losses FROM daily",
    "k3_risk_state": f"""WITH {DAILY} SELECT account, CASE WHEN day_pnl <= -20 THEN 'locked_loss' WHEN day_pnl >= 60 THEN 'locked_profit' WHEN losses >= 2 THEN 'locked_streak' WHEN day_trades >= 3 THEN 'halted' ELSE 'idle' END AS risk_state,
      count(*) AS n FROM daily GROUP BY ALL""",
    "k4_live_state": f"""WITH RECURSIVE {_LIVE} SELECT account, seq, live AS live_state, live IN ('idle', 'armed') AS can_enter, total AS day_pnl, trades::INTEGER AS day_trades, run::BIGINT AS losses
      FROM engine JOIN n USING (account, i)""",
    # In decimals: P&L is whole cents, and a sum that equals a limit reaches it, whatever doubles would make of it.
    "k5_k7_evaluation": f"""WITH {TRADES}, curve AS (
      SELECT *, pnl::DECIMAL(18, 2) AS cents, sum(pnl::DECIMAL(18, 2)) OVER (PARTITION BY account ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS cum FROM trades
      ), p AS (
      SELECT *, greatest(0, max(cum) OVER (PARTITION BY account ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)) AS peak, sum(cents) OVER (PARTITION BY account, ts::DATE ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS day_pnl FROM curve
      ), q AS (SELECT *, max((peak - cum >= 40)::INTEGER) OVER (PARTITION BY account ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS t, max((day_pnl <= -25)::INTEGER) OVER (PARTITION BY account, ts::DATE ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS d FROM p)
      SELECT account, trade_id, ts, cum::DOUBLE AS cum_pnl, peak::DOUBLE AS peak, (peak - cum)::DOUBLE AS trailing_dd, CASE WHEN t = 1 THEN 'trailing' WHEN d = 1 THEN 'daily' END AS lock,
        {_r6("least(cum::DOUBLE / 300.0, 1)")} AS progress, cum >= 300 AS target_reached FROM q""",
    "x1_window_plan": f"""WITH {NUMBERED}, n AS (SELECT symbol, count(*) AS n FROM numbered GROUP BY symbol HAVING count(*) >= 400), w AS (SELECT symbol, unnest(range(0, n - 399, 100)) AS start FROM n)
      SELECT symbol, (start // 100)::INTEGER AS window_idx, start, start + 300 AS train_end, start + 400 AS test_end FROM w""",
    "x2_window_assignment": f"""WITH {NUMBERED}, n AS (SELECT symbol, count(*) AS n FROM numbered GROUP BY symbol HAVING count(*) >= 400), w AS (SELECT symbol, unnest(range(0, n - 399, 100)) AS start FROM n)
      SELECT w.symbol, (start // 100)::INTEGER AS window_idx, CASE WHEN bar_no < start + 300 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(bar_no) AS first, max(bar_no) AS last
      FROM w JOIN numbered b ON b.symbol = w.symbol AND bar_no >= start AND bar_no < start + 400 GROUP BY ALL""",
    "x4_stability": f"WITH RECURSIVE {SCORED} SELECT symbol, {_r6('coalesce(avg(same), 1)')} AS stability FROM (SELECT symbol, (state = lag(state) OVER (PARTITION BY symbol ORDER BY bar_no))::INTEGER AS same FROM scored) GROUP BY symbol",
    "x5_dominant_regime": f"""WITH RECURSIVE {SCORED}, c AS (SELECT symbol, state, count(*) AS n FROM scored GROUP BY ALL), d AS (SELECT symbol, state AS dominant_state FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, state) = 1)
      SELECT *, ['low_vol', 'trending', 'high_vol'][dominant_state + 1] AS dominant_regime FROM d""",
    "b1_model_details": "SELECT DISTINCT event_type AS symbol, 3 AS k, '2024-03-01T00:00:00Z' AS trained_at, 8000::BIGINT AS training_bars, -20000.0::DOUBLE AS log_likelihood, true AS converged FROM events",
    "b2_transition_table": f"""SELECT symbol, ['low_vol', 'trending', 'high_vol'][i + 1] AS from_label, ['low_vol', 'trending', 'high_vol'][j + 1] AS to_label, ({_TRANSITION}[i + 1][j + 1])::DOUBLE AS probability
      FROM (SELECT DISTINCT event_type AS symbol FROM events), (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)""",
    "b3_request_counts": "SELECT event_type AS symbol, count(*) AS requests, count_if(event_id % 50 = 0)::BIGINT AS errors, round(avg(event_id % 7), 3) AS mean_latency_ms FROM events GROUP BY 1",
    "b4_overview": """WITH names AS (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT unnest(['NQ', 'ES', 'CL', 'NG', 'GC', 'SI', 'ZB', 'UB']))
      SELECT n.symbol, CASE WHEN e.n > 0 AND n.symbol <> 'click' THEN 'low_vol,trending,high_vol' END AS labels, coalesce(e.n, 0) AS requests, NOT (coalesce(e.n, 0) > 0 AND n.symbol <> 'click') AS missing_model
      FROM names n LEFT JOIN (SELECT event_type AS symbol, count(*) AS n FROM events GROUP BY 1) e ON e.symbol = n.symbol""",
    "m12_model_status": "SELECT event_type AS symbol, 2 AS version, 3 AS k, '2024-03-01T00:00:00Z' AS trained_at, 8000::BIGINT AS training_bars, count(*) AS requests FROM events GROUP BY 1",
}
