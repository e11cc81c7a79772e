"""Naive and moving-average models as pure array expressions.

Each function maps the ``hist`` array of one (id, dsr) to an ``array<double>`` of ``h``
forecasts, or NULL when its guard fails. All of them are evaluated in one narrow
projection, so adding a model adds no shuffle and no second pass over the panel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import series as sa
from ..functions.calendar import season_length

# Moving-average window lengths (short, middle, long) by frequency.
WINDOWS = {
    "01": {"d": 7, "m": 3, "q": 2, "y": 2},
    "02": {"d": 30, "m": 6, "q": 4, "y": 5},
    "03": {"d": 90, "m": 12, "q": 8, "y": 10},
}


def _flat(value: Column, h: int) -> Column:
    return F.array_repeat(value, h)


def naive(hist: Column, h: int) -> Column:
    return _flat(F.element_at(hist, -1), h)


def seasonal_naive(hist: Column, h: int, freq: str) -> Column:
    p = season_length(freq)
    n = F.size(hist)
    tiled = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda k: sa.at(hist, n - p + k % p))
    return F.when(n >= p, tiled)


def sma(hist: Column, h: int, n: int) -> Column:
    return _flat(sa.array_mean(sa.tail(hist, n)), h)


def wma(hist: Column, h: int, n: int) -> Column:
    """Weights 1..n, newest heaviest; a short history keeps the largest weights."""
    last = sa.tail(hist, n)
    size = F.size(last)
    weighted = F.transform(last, lambda v, i: v * (i + 1 + n - size))
    total = (n + (n - size + 1)) * size / 2.0
    return _flat(F.try_divide(sa.array_sum(weighted), total), h)


def ema(hist: Column, h: int, n: int) -> Column:
    """Adjusted exponential mean over the whole history, span ``n``."""
    keep = 1.0 - 2.0 / (n + 1)
    acc = F.aggregate(
        hist,
        F.struct(sa.zero().alias("num"), sa.zero().alias("den")),
        lambda a, v: F.struct(
            (a["num"] * keep + v).alias("num"), (a["den"] * keep + 1.0).alias("den")
        ),
        lambda a: F.try_divide(a["num"], a["den"]),
    )
    return _flat(acc, h)


def expressions(hist: Column, h: int, freq: str, names: Sequence[str]) -> dict[str, Column]:
    """Forecast arrays of the native models among ``names``."""
    averages = {"sma": sma, "wma": wma, "ema": ema}
    out = {}
    for name in names:
        kind, size = name[:-2], name[-2:]
        if name == "naive01":
            out[name] = naive(hist, h)
        elif name == "snaive01":
            out[name] = seasonal_naive(hist, h, freq)
        elif kind in averages:
            out[name] = averages[kind](hist, h, WINDOWS[size][freq])
    return out
