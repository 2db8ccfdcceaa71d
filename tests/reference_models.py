"""Straight loops over one list of values, written from the formulas."""

import math

import numpy as np


def decompose_forecast(y, horizon, window=7, period=7):
    n, half = len(y), window // 2
    trend = [np.mean(y[max(0, i - half): i + half + 1]) for i in range(n)]
    means = [np.mean(y[p::period]) if len(y[p::period]) else 0.0 for p in range(period)]
    profile = [m - np.mean(means) for m in means]
    sd = np.std([y[i] - trend[i] - profile[i % period] for i in range(n)], ddof=1)
    out = []
    for h in range(1, horizon + 1):
        f = max(0.0, trend[-1] + h * (trend[-1] - trend[-2]) + profile[(h - 1) % period])
        out.append((f, max(0.0, f - 1.96 * sd * math.sqrt(h)), f + 1.96 * sd * math.sqrt(h)))
    return out


def weighted_forecast(y, horizon, newest_heavy=False):
    values, n0 = list(y), len(y)
    span = max(2, min(n0 // 4, 30))
    out = []
    for k in range(horizon):
        n = len(values)
        tail = values[-span:]
        weights = [(j + 1 + span - len(tail)) if newest_heavy else (len(tail) - j) for j in range(len(tail))]
        level = sum(w * v for w, v in zip(weights, tail)) / sum(weights)
        slope = float(np.polyfit(range(n), values, 1)[0]) if n > 1 else 0.0
        season = np.mean(values[(n + k) % 7::7]) - np.mean(values) if n >= 14 else 0.0
        values.append(max(0.0, level + slope * (k + 1) + season))
        out.append(values[-1])
    return out


def lookback_forecast(y, horizon, size=14):
    mean, sd = np.mean(y), max(0.1, np.std(y))
    z = [(v - mean) / sd for v in y[-size:]]
    out = []
    for _ in range(horizon):
        w = z[-size:]
        s = sum(v / (1 + math.exp(-10 * (j / size - 0.5))) for j, v in enumerate(w)) + 0.2 * (w[-1] - w[-3])
        z.append(2 * math.tanh(0.5 * s))
        out.append(max(0.0, z[-1] * sd + mean))
    return out


def ssa_rule(y, window, components):
    rows = np.lib.stride_tricks.sliding_window_view(np.asarray(y, float), window)
    mean = rows.mean(0)
    _, vectors = np.linalg.eigh(np.cov(rows.T))
    top = vectors[:, ::-1][:, :components]
    weights = top @ top[-1]
    return mean[-1] - mean @ weights, weights


def ssa_forecast(y, horizon, window=7, components=3):
    a, w = ssa_rule(y, window, components)
    values = list(y)
    for _ in range(horizon):
        values.append(float(a + np.dot(w, values[-window:])))
    return values[len(y):]
