"""Keyed state over streams: features, scoring, hysteresis, drift and live risk, one event at a time with the batch results.

Each processor keeps what its recursion needs for one key. Events of a key are taken in the order of (ts, seq) within a
micro-batch; events that come late are not woven into the past: the next batch run repairs history.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barwright.functions.scalar import SMALL
from barwright.operators import drift
from barwright.operators.features import PERIOD, VOL_WINDOW, VOLUME_WINDOW, WARM_UP, Z_WINDOW
from barwright.sources.schema import FEATURES, session_id

STATE = "value string"


class _Keyed(StatefulProcessor):
    """One JSON document of state a key; `step` turns an event and the state into an output row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("state", STATE)

    def fresh(self) -> dict:
        raise NotImplementedError

    def step(self, event, state: dict) -> dict:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self._state.get()[0]) if self._state.exists() else self.fresh()
        frame = pd.concat(list(rows), ignore_index=True)
        order = [c for c in ("ts", "seq") if c in frame.columns]
        out = [self.step(event, state) for event in frame.sort_values(order, kind="stable").itertuples(index=False)]
        self._state.update((json.dumps(state),))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _mean_std(values: list[float]) -> tuple[float, float]:
    array = np.asarray(values)
    return float(array.mean()), float(array.std(ddof=1)) if len(array) > 1 else 0.0


def _rounded(x: float) -> float:
    """To four places, halves up as in the batch."""
    return math.floor(x * 1e4 + 0.5) / 1e4


def _z(values: list[float]) -> float:
    mean, std = _mean_std(values)
    z = (values[-1] - mean) / max(std, SMALL)
    return z if math.isfinite(z) else 0.0


class FeatureState(_Keyed):
    """The last returns, volatilities and volumes, Wilder's averages and the session's sums of one symbol."""

    OUT = "symbol string, ts timestamp, seq bigint, ready boolean, " + ", ".join(f"{f} double" for f in FEATURES)

    def fresh(self):
        return {"n": 0, "close": None, "returns": [], "vols": [], "volumes": [], "gains": [], "losses": [], "ranges": [], "gain": 0.0, "loss": 0.0, "atr": 0.0, "session": None, "pv": 0.0, "v": 0.0}

    def step(self, e, s):
        previous, n = s["close"], s["n"]
        ret = math.log(e.close / previous) if previous and previous > 0 and e.close > 0 else 0.0
        s["returns"] = [*s["returns"], ret][-Z_WINDOW:]
        s["vols"] = [*s["vols"], _mean_std(s["returns"][-VOL_WINDOW:])[1]][-Z_WINDOW:]
        s["volumes"] = [*s["volumes"], e.volume][-VOLUME_WINDOW:]
        true_range = e.high - e.low if previous is None else max(e.high - e.low, abs(e.high - previous), abs(e.low - previous))
        change = 0.0 if previous is None else e.close - previous
        rsi = 50.0
        if n == PERIOD or n < PERIOD:
            if n:
                s["gains"].append(max(change, 0.0))
                s["losses"].append(max(-change, 0.0))
            if n == PERIOD:
                s["gain"], s["loss"] = sum(s["gains"]) / PERIOD, sum(s["losses"]) / PERIOD
        else:
            s["gain"] = (s["gain"] * (PERIOD - 1) + max(change, 0.0)) / PERIOD
            s["loss"] = (s["loss"] * (PERIOD - 1) + max(-change, 0.0)) / PERIOD
        if n >= PERIOD:
            rsi = (100.0 if s["gain"] > 0 else 50.0) if s["loss"] < SMALL else 100 - 100 / (1 + s["gain"] / s["loss"])
        if n < PERIOD - 1:
            s["ranges"].append(true_range)
            atr = true_range
        elif n == PERIOD - 1:
            atr = s["atr"] = (sum(s["ranges"]) + true_range) / PERIOD
        else:
            atr = s["atr"] = (s["atr"] * (PERIOD - 1) + true_range) / PERIOD
        day = e.session
        if day != s["session"]:
            s["session"], s["pv"], s["v"] = day, 0.0, 0.0
        s["pv"] += (e.high + e.low + e.close) / 3 * e.volume
        s["v"] += e.volume
        vwap, floor = s["pv"] / max(s["v"], SMALL), max(atr, SMALL)
        clip = lambda x, a, b: min(max(x, a), b) if math.isfinite(x) else 0.0
        values = [_z(s["returns"]), _z(s["vols"]), (rsi - 50) / 50, clip((e.close - vwap) / floor, -3, 3), clip((e.high - e.low) / floor, 0, 5), clip(_z(s["volumes"]), -3, 3) if n else 0.0]
        s["close"], s["n"] = e.close, n + 1
        return {"symbol": e.symbol, "ts": e.ts, "seq": e.seq, "ready": n >= WARM_UP - 1, **dict(zip(FEATURES, values, strict=True))}


class ScoreState(_Keyed):
    """Forward filter of one symbol. Its model comes with the events (model: JSON text); another version starts it anew."""

    OUT = "symbol string, ts timestamp, seq bigint, state_probs array<double>, state int, confidence double, step_ll double, model_version string"

    #: The model read last, as text and parsed: events that follow one another mostly share theirs.
    _read = (None, None)

    def fresh(self):
        return {"version": None, "alpha": None}

    def step(self, e, s):
        if self._read[0] != e.model:
            self._read = (e.model, json.loads(e.model))
        model = self._read[1]
        version = model["metadata"]["trained_at"]
        if s["version"] != version:
            s["version"], s["alpha"] = version, model["initial_probs"]
        x, v = np.asarray(e.features, float), np.maximum(np.array(model["variances"]), 1e-6)
        log_e = -0.5 * (len(x) * math.log(2 * math.pi) + np.log(v).sum(axis=1) + ((x - np.array(model["means"])) ** 2 / v).sum(axis=1))
        joint = np.log(np.maximum(np.asarray(s["alpha"]) @ np.array(model["transition_matrix"]), 1e-300)) + log_e
        top = joint.max()
        weights = np.exp(joint - top) if np.isfinite(top) else np.zeros(len(joint))
        total = weights.sum()
        good = bool(np.isfinite(total) and total > 0)
        alpha = weights / total if good else np.full(len(joint), 1 / len(joint))
        s["alpha"] = alpha.tolist()
        return {"symbol": e.symbol, "ts": e.ts, "seq": e.seq, "state_probs": s["alpha"], "state": int(alpha.argmax()), "confidence": float(alpha.max()), "step_ll": float(top + np.log(total)) if good else 0.0, "model_version": version}


class HysteresisState(_Keyed):
    """The regime automaton of one symbol; flips start anew with each day."""

    OUT = "symbol string, ts timestamp, seq bigint, regime int, flips int"

    def __init__(self, confidence: float = 0.55, dwell: int = 3, max_flips: int = 6):
        self.confidence, self.dwell, self.max_flips = confidence, dwell, max_flips

    def fresh(self):
        return {"regime": -1, "candidate": -1, "count": 0, "flips": 0, "session": None}

    def step(self, e, s):
        day = e.session
        if day != s["session"]:
            s["session"], s["flips"] = day, 0
        if e.confidence >= self.confidence and s["flips"] < self.max_flips:
            if s["regime"] < 0:
                s["regime"] = s["candidate"] = e.state
                s["count"] = self.dwell
            elif e.state == s["regime"]:
                s["candidate"], s["count"] = s["regime"], 0
            else:
                s["count"] = s["count"] + 1 if e.state == s["candidate"] else 1
                s["candidate"] = e.state
                if s["count"] >= self.dwell:
                    s["regime"], s["count"], s["flips"] = e.state, 0, s["flips"] + 1
        return {"symbol": e.symbol, "ts": e.ts, "seq": e.seq, "regime": int(s["regime"]), "flips": s["flips"]}


class DriftState(_Keyed):
    """The last states, likelihoods and features of one symbol; after each event the measures against its model, and whether to retrain.

    Events hold state, step_ll, the six features and model (JSON text). The same measures as operators.drift on the same rows.
    """

    OUT = "symbol string, ts timestamp, seq bigint, n int, ready boolean, occupancy_drift double, transition_drift double, likelihood_drop double, mean_ll double, reasons string, retrain boolean"

    def __init__(self, k: int = 3, window: int = drift.WINDOW, baseline: str = "per_bar"):
        self.k, self.window, self.baseline = k, window, baseline

    def fresh(self):
        return {"states": [], "lls": [], "features": []}

    def step(self, e, s):
        s["states"] = [*s["states"], int(e.state)][-self.window :]
        s["lls"] = [*s["lls"], float(e.step_ll)][-self.window :]
        s["features"] = [*s["features"], [float(getattr(e, f)) for f in FEATURES]][-self.window :]
        model, n, k = json.loads(e.model), len(s["states"]), self.k
        states, x = np.array(s["states"]), np.array(s["features"])
        even = n / k
        occupancy = float((((np.bincount(states[(states >= 0) & (states < k)], minlength=k) - even) ** 2 / even).sum()) / k)
        moves = np.zeros((k, k))
        np.add.at(moves, (states[:-1], states[1:]), 1)
        p = np.clip(moves / np.maximum(moves.sum(axis=1, keepdims=True), 1), SMALL, 1)
        q = np.clip(np.array(model["transition_matrix"]), SMALL, 1)
        transition = 0.0 if n < drift.LEAST_STATES else max(0.0, float((p * np.log(p / q)).sum() / k))
        trained = model["metadata"]["log_likelihood"] / (max(model["metadata"]["training_bars"], 1) if self.baseline == "per_bar" else 1)
        mean = sum(s["lls"]) / n
        drop = 0.0 if trained == 0 else min(max((trained - mean) / max(1.0, abs(trained)), 0.0), 1.0)
        moved = np.zeros(len(FEATURES))
        if n >= drift.LEAST_ROWS:
            std = np.maximum(model["feature_std"], SMALL)
            moved = 0.7 * np.abs(x.mean(axis=0) - model["feature_mean"]) / std + 0.3 * np.abs(np.log(np.maximum(x.std(axis=0, ddof=1), SMALL) / std))
        measures, ready = {"occupancy": _rounded(occupancy), "transition": _rounded(transition), "likelihood": _rounded(drop)}, n >= min(drift.READY, self.window)
        reasons = [name for name, value in measures.items() if value > drift.THRESHOLDS[name]]
        reasons += [f"feature:{f}" for f, d in zip(FEATURES, moved, strict=True) if _rounded(float(d)) > drift.THRESHOLDS["feature"]][:1]
        reasons = reasons if ready else []
        found = {"n": n, "ready": ready, "occupancy_drift": measures["occupancy"], "transition_drift": measures["transition"], "likelihood_drop": measures["likelihood"], "mean_ll": mean}
        return {"symbol": e.symbol, "ts": e.ts, "seq": e.seq, **found, "reasons": ",".join(reasons), "retrain": bool(reasons)}


class RiskState(_Keyed):
    """The live state of one account over signals, entries, exits and stops (kind, pnl)."""

    OUT = "account string, ts timestamp, seq bigint, live_state string, day_pnl double, day_trades int, losses int"

    def __init__(self, max_loss: float = 1000.0, profit_lock: float = 1500.0, max_trades: int = 10, max_losses: int = 3):
        self.limits = (max_loss, profit_lock, max_trades, max_losses)

    def fresh(self):
        return {"state": "idle", "day": None, "pnl": 0.0, "trades": 0, "losses": 0}

    def step(self, e, s):
        max_loss, profit_lock, max_trades, max_losses = self.limits
        day = e.session
        if day != s["day"]:
            s["day"] = day
            if s["state"] != "emergency_stop":
                s |= {"state": "idle", "pnl": 0.0, "trades": 0, "losses": 0}
        if e.kind == "clear":
            s["state"] = "idle"
        elif e.kind == "stop":
            s["state"] = "emergency_stop"
        elif e.kind == "exit":
            pnl = 0.0 if e.pnl is None or math.isnan(e.pnl) else e.pnl
            s["pnl"] += pnl
            s["losses"] = s["losses"] + 1 if pnl < 0 else 0
            if s["state"] != "emergency_stop":
                locked = s["pnl"] <= -max_loss or profit_lock > 0 and s["pnl"] >= profit_lock or s["losses"] >= max_losses
                s["state"] = "locked" if locked else "halted" if s["trades"] >= max_trades else "idle"
        elif s["state"] in ("idle", "armed"):
            if e.kind == "entry":
                s["state"], s["trades"] = "in_trade", min(s["trades"] + 1, max_trades)
            elif e.kind == "signal":
                s["state"] = "armed"
        return {"account": e.account, "ts": e.ts, "seq": e.seq, "live_state": s["state"], "day_pnl": s["pnl"], "day_trades": s["trades"], "losses": s["losses"]}


def apply(stream: DataFrame, processor: _Keyed, key: str = "symbol", session: str = "UTC", session_start: str = "00:00") -> DataFrame:
    """The processor's output rows for a stream (or a batch frame) grouped by key. Needs the RocksDB state store, see use_rocksdb().

    Sessions, which reset what a processor keeps for a day, begin at session_start in the time zone `session`, through its changes
    of clocks, as in schema.session_id; each event carries its own and the state keeps the last one.
    """
    rows = stream.withColumn("session", session_id(F.col("ts"), session, session_start).cast("string"))
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=processor.OUT, outputMode="append", timeMode="none")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
