"""Exponential smoothing (simple, additive trend, additive trend and season) by grid search.

The parameters with the lowest one-step squared error win: a coarse grid, then one finer
grid around the winner. All series of an Arrow batch with equal length and all grid points
advance together, one vector operation per period.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.calendar import season_length

# Model name -> number of smoothing parameters (level, trend, season).
MODELS = {"expo01": 1, "expo02": 2, "expo03": 3}
FINE_LEVELS = [round(0.1 * i, 2) for i in range(1, 10)]
COARSE_LEVELS = [0.1, 0.3, 0.5, 0.7, 0.9]  # three parameters: 125 points instead of 729
CHUNK = 2_000_000  # state values held at once


def _grid(k: int) -> np.ndarray:
    levels = COARSE_LEVELS if k == 3 else FINE_LEVELS
    return np.array(list(itertools.product(levels, repeat=k)))


def _around(best: np.ndarray, k: int) -> np.ndarray:
    steps = [-0.1, 0.0, 0.1] if k == 3 else [-0.1, -0.05, 0.0, 0.05, 0.1]
    moves = np.array(list(itertools.product(steps, repeat=k)))
    return np.clip(np.round(best[:, None, :] + moves[None], 2), 0.01, 0.99)


def _run(y: np.ndarray, par: np.ndarray, k: int, p: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """SSE (rows, grid) and forecasts (rows, grid, h) for series (rows, n) and parameters."""
    rows, n = y.shape
    g = par.shape[1]
    alpha = par[:, :, 0]
    beta = par[:, :, 1] if k > 1 else 0.0
    gamma = par[:, :, 2] if k > 2 else 0.0
    shape = np.ones((1, g))
    if k == 3:
        first = y[:, :p].mean(axis=1, keepdims=True)
        level = first * shape
        trend = (y[:, p : 2 * p].mean(axis=1, keepdims=True) - first) / p * shape
        season = [(y[:, j : j + 1] - first) * shape for j in range(p)]
        start = p
    else:
        level = y[:, :1] * shape
        trend = (y[:, 1:2] - y[:, :1]) * shape if k == 2 else np.zeros((rows, g))
        season = [0.0] * p
        start = 1
    sse = np.zeros((rows, g))
    for t in range(start, n):
        s = season[t % p]
        base = level + trend
        err = y[:, t : t + 1] - (base + s)
        sse += err * err
        new = base + alpha * err
        if k > 1:
            trend = trend + beta * (new - level - trend)
        if k > 2:
            season[t % p] = s + gamma * (y[:, t : t + 1] - base - s)
        level = new
    ahead = [level + (i + 1) * trend + season[(n + i) % p] for i in range(h)]
    return sse, np.stack([np.broadcast_to(a, (rows, g)) for a in ahead], axis=2)


def _fit(y: np.ndarray, k: int, p: int, h: int) -> np.ndarray:
    rows = np.arange(len(y))
    coarse = _grid(k)
    sse, _ = _run(y, np.broadcast_to(coarse, (len(y), *coarse.shape)), k, p, h)
    near = _around(coarse[sse.argmin(axis=1)], k)
    sse, ahead = _run(y, near, k, p, h)
    return ahead[rows, sse.argmin(axis=1)]


def smooth(series: Sequence[np.ndarray], name: str, p: int, h: int) -> list[np.ndarray | None]:
    """Forecasts per series, None where the history is too short."""
    k = MODELS[name]
    if k == 3 and p <= 1:
        return [None] * len(series)
    need = 2 * p if k == 3 else 2
    out: list[np.ndarray | None] = [None] * len(series)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(series):
        if len(s) >= need:
            by_length.setdefault(len(s), []).append(i)
    step = max(1, CHUNK // (len(_grid(k)) * (p if k == 3 else 1)))
    for members in by_length.values():
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            for i, f in zip(part, _fit(np.stack([series[i] for i in part]), k, p if k == 3 else 1, h)):
                out[i] = f
    return out


def expressions(hist: Column, h: int, freq: str, names: Sequence[str]) -> dict[str, Column]:
    """``array<double>`` forecasts per model; all requested models share one Python pass."""
    p = season_length(freq)
    names = list(names)

    @F.pandas_udf(", ".join(f"{n} array<double>" for n in names))
    def run(hist: pd.Series) -> pd.DataFrame:
        series = [np.asarray(s, dtype=float) for s in hist]
        return pd.DataFrame({n: smooth(series, n, p, h) for n in names})

    packed = run(hist)
    return {n: packed[n] for n in names}
