"""Small frames, and plain sequential versions of the recursions."""

import math
from datetime import datetime, timedelta

import numpy as np

from barwright.sources.schema import BARS

START = datetime(2024, 1, 2)


def walk(n, seed=42, symbol="NQ", minutes=5):
    """A random walk of n bars."""
    random = np.random.default_rng(seed)
    close = 15000 + np.cumsum(10 * random.standard_normal(n))
    high, low = close + np.abs(5 * random.standard_normal(n)), close - np.abs(5 * random.standard_normal(n))
    open_, volume = close + 3 * random.standard_normal(n), np.abs(1000 * random.standard_normal(n) + 5000)
    return [(symbol, START + timedelta(minutes=minutes * i), i, *map(float, (open_[i], high[i], low[i], close[i], volume[i]))) for i in range(n)]


def bars(spark, rows):
    return spark.createDataFrame(rows, BARS)


def sequential_features(rows):
    """The six features bar by bar, by the book."""
    out, returns, vols, volumes = [], [], [], []
    gains, losses, ranges = [], [], []
    ag = al = atr = pv = v = 0.0
    previous = session = None

    def z(values):
        std = np.std(values, ddof=1) if len(values) > 1 else 0.0
        return (values[-1] - np.mean(values)) / max(std, 1e-10)

    for n, (_, ts, _, o, h, low, c, volume) in enumerate(rows):
        returns.append(math.log(c / previous) if previous and previous > 0 else 0.0)
        window = returns[-20:]
        vols.append(np.std(window, ddof=1) if len(window) > 1 else 0.0)
        volumes.append(volume)
        tr = h - low if previous is None else max(h - low, abs(h - previous), abs(low - previous))
        change = 0.0 if previous is None else c - previous
        if 0 < n <= 14:
            gains.append(max(change, 0))
            losses.append(max(-change, 0))
        if n == 14:
            ag, al = np.mean(gains), np.mean(losses)
        elif n > 14:
            ag, al = (ag * 13 + max(change, 0)) / 14, (al * 13 + max(-change, 0)) / 14
        rsi = 50.0 if n < 14 else (100.0 if ag > 0 else 50.0) if al < 1e-10 else 100 - 100 / (1 + ag / al)
        ranges.append(tr)
        atr = tr if n < 13 else np.mean(ranges) if n == 13 else (atr * 13 + tr) / 14
        if ts.date() != session:
            session, pv, v = ts.date(), 0.0, 0.0
        pv, v = pv + (h + low + c) / 3 * volume, v + volume
        vwap = pv / max(v, 1e-10)
        out.append([z(returns[-100:]), z(vols[-100:]), (rsi - 50) / 50, min(max((c - vwap) / max(atr, 1e-10), -3), 3), min(max((h - low) / max(atr, 1e-10), 0), 5), min(max(z(volumes[-20:]), -3), 3) if n else 0.0])
        previous = c
    return np.nan_to_num(np.array(out), posinf=0, neginf=0)


def sequential_filter(x, model):
    alpha, out, steps = np.array(model["initial_probs"]), [], []
    move, means, variances = (np.array(model[k]) for k in ("transition_matrix", "means", "variances"))
    for row in x:
        log_e = -0.5 * (len(row) * math.log(2 * math.pi) + np.log(variances).sum(axis=1) + ((row - means) ** 2 / variances).sum(axis=1))
        joint = np.log(np.maximum(alpha @ move, 1e-300)) + log_e
        top = joint.max()
        if not np.isfinite(top):  # no state explains the row
            alpha = np.full(len(alpha), 1 / len(alpha))
            out.append(alpha)
            steps.append(0.0)
            continue
        weights = np.exp(joint - top)
        alpha = weights / weights.sum()
        out.append(alpha)
        steps.append(top + math.log(weights.sum()))
    return np.array(out), np.array(steps)


def sequential_path(x, model):
    move, means, variances = (np.array(model[k]) for k in ("transition_matrix", "means", "variances"))
    log_e = [-0.5 * (len(r) * math.log(2 * math.pi) + np.log(variances).sum(axis=1) + ((r - means) ** 2 / variances).sum(axis=1)) for r in x]
    log = lambda p: np.log(np.maximum(p, 1e-300))
    score, back = log(model["initial_probs"]) + log_e[0], []
    for e in log_e[1:]:
        both = score[:, None] + log(move)
        back.append(both.argmax(axis=0))
        score = both.max(axis=0) + e
    path = [int(score.argmax())]
    for came in back[::-1]:
        path.append(int(came[path[-1]]))
    return path[::-1]
