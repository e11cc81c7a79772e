"""Additive daily model: piecewise linear trend with yearly and weekly Fourier terms.

Fitted by ridge regression on the daily history, predicted by day and summed per bucket. A batch of histories is one matrix; the
normal equations of all its series are solved as one stack.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from .arima import packed, valid

MODELS = ("prophet01",)
# Days looked ahead per forecast period.
DAYS_AHEAD = {"d": 1, "m": 31, "q": 93, "y": 366}
HINGES = 25
HINGE_RANGE = 0.8
YEARLY, WEEKLY = 10, 3  # Fourier orders
SEASONS = ((365.25, YEARLY, 730), (7.0, WEEKLY, 14))  # days, order, days of history that a season needs
RIDGE_HINGE, RIDGE_SEASON = 1.0, 1e-3
COLUMNS = 2 + HINGES + 2 * (YEARLY + WEEKLY)
CELLS = 8_000_000  # numbers of the designs that a task holds


def basis(days: np.ndarray, start: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Design (series, columns, days) for absolute day numbers (series, days); columns that a series is too short for are 0."""
    t = (days - start[:, None]) / np.maximum(span - 1, 1)[:, None]
    out = np.zeros((len(days), COLUMNS, days.shape[1]))
    out[:, 0], out[:, 1] = 1.0, t
    hinges = np.clip((span * HINGE_RANGE).astype(int) - 1, 0, HINGES)
    for j in range(1, HINGES + 1):
        knot = HINGE_RANGE * j / np.maximum(hinges, 1)
        out[:, 1 + j] = np.maximum(t - knot[:, None], 0) * (j <= hinges)[:, None]
    at = 2 + HINGES
    for period, order, needed in SEASONS:
        for k in range(1, order + 1):
            arg = 2 * np.pi * k * days / period
            long = (span >= needed)[:, None]
            out[:, at], out[:, at + 1] = np.sin(arg) * long, np.cos(arg) * long
            at += 2
    return out


WEIGHT = np.concatenate(([0.0, 0.0], np.full(HINGES, RIDGE_HINGE), np.full(2 * (YEARLY + WEEKLY), RIDGE_SEASON)))


def fit_predict(y: np.ndarray, n: np.ndarray, start: np.ndarray, ahead: int) -> np.ndarray:
    """Predictions of the ``ahead`` days after each history (rows of ``y`` that end in the last column, two days or longer)."""
    days = start[:, None] + n[:, None] + np.arange(-y.shape[1], 0)
    x = basis(days, start, n) * valid(y, n)[:, None, :]
    scale = np.abs(y).max(axis=1)
    scale = np.where(scale > 0, scale, 1.0)
    coef = np.linalg.solve(x @ x.transpose(0, 2, 1) + np.diag(WEIGHT), x @ (y / scale[:, None])[:, :, None])
    later = basis(start[:, None] + n[:, None] + np.arange(ahead), start, n)
    return (coef.transpose(0, 2, 1) @ later)[:, 0] * scale[:, None]


def summed(series: list, start: np.ndarray, edges: list, ahead: int) -> list:
    """Sums per bucket of the predictions of each series, None where it is too short or its values or forecast aren't finite."""
    series = [np.asarray(s, dtype=float) for s in series]
    out: list[np.ndarray | None] = [None] * len(series)
    fit = np.flatnonzero([len(s) > 1 and bool(np.isfinite(s).all()) for s in series])
    longest = max((len(series[i]) for i in fit), default=1)
    for part in np.array_split(fit, max(1, -(-len(fit) * longest * COLUMNS // CELLS))):
        if not len(part):
            continue
        with np.errstate(over="ignore", invalid="ignore"):
            y, n = packed([series[i] for i in part])
            daily = fit_predict(y, n, start[part], ahead)
            total = np.concatenate([np.zeros((len(part), 1)), np.cumsum(daily, axis=1)], axis=1)
            cuts = np.clip(np.stack([np.asarray(edges[i], dtype=int) for i in part]) - (start[part] + n)[:, None], 0, ahead)
            sums = np.diff(np.take_along_axis(total, cuts, axis=1), axis=1)
        good = np.isfinite(daily).all(axis=1)
        for i, ok, s in zip(part, good, sums, strict=True):
            out[i] = s if ok else None
    return out


def forecasts(daily: DataFrame, freq: str, h: int) -> DataFrame:
    """Rows ``id, dsr, s0, f``; ``daily`` holds daily histories, one row per (id, dsr)."""
    s0 = cal.horizon_index(F.col("dsr"), freq)
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(h)), lambda k: F.unix_date(cal.period_start_date(s0 + k, freq))
    )
    days_ahead = h * DAYS_AHEAD[freq]

    @F.pandas_udf("array<double>")
    def solve(hist: pd.Series, b0: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series(summed(hist.tolist(), b0.to_numpy().astype(int), edges.tolist(), days_ahead), dtype=object)

    return (
        daily.withColumn("f", solve("hist", "b0", edges))
        .filter(F.col("f").isNotNull())
        .select("id", "dsr", s0.alias("s0"), "f")
    )
