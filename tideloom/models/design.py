"""Model features as array expressions over one (id, dsr) history.

The same function gives the features of a training position and of a forecast position, the
latter on a history that already holds the earlier predictions. Positions count from 0 at the
first bucket ``b0``; all lags look at earlier positions only. The trend and residual of the
decomposition come with lag 3, so the centred filter never reaches the value to predict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import series as sa
from ..operators.features import PART_DOMAINS
from ..operators.growth import growth_rate

# Calendar parts by frequency, in the order of the dummy blocks.
PARTS = {
    "d": ("day", "dayofyear", "weekofyear", "weekday", "month", "quarter"),
    "m": ("month", "quarter"),
    "q": ("quarter",),
    "y": (),
}
DEC_LAG = 3


def n_dummies(freq: str) -> int:
    return sum(len(PART_DOMAINS[p]) for p in PARTS[freq])


def _part(idx: Column, part: str, freq: str) -> Column:
    """Zero-based code of a calendar part for a period index."""
    if freq == "m":
        month = F.pmod(idx, F.lit(12))
        return (month if part == "month" else F.floor(month / 3)).cast("int")
    if freq == "q":
        return F.pmod(idx, F.lit(4)).cast("int")
    ds = cal.period_start_date(idx, freq)
    if part == "weekday":
        return F.weekday(ds)
    fn = {
        "day": F.dayofmonth, "dayofyear": F.dayofyear, "weekofyear": F.weekofyear,
        "month": F.month, "quarter": F.quarter,
    }[part]
    return fn(ds) - 1


def codes(idx: Column, freq: str) -> list[Column]:
    """Columns of the one-hot block that are 1 for a period index."""
    out, offset = [], 0
    for part in PARTS[freq]:
        out.append((_part(idx, part, freq) + offset).cast("int"))
        offset += len(PART_DOMAINS[part])
    return out


def year_back(idx: Column, freq: str) -> Column:
    """How many periods lie between a bucket and the one 12 months earlier."""
    if freq != "d":
        return F.lit(cal.FREQS[freq].season)
    ds = cal.period_start_date(idx, "d")
    return F.datediff(ds, F.add_months(ds, -12))


def anchor_back(idx: Column, freq: str) -> Column:
    """Distance to the value a growth forecast multiplies; NULL when there is none (29 Feb)."""
    if freq != "d":
        return F.lit(cal.FREQS[freq].season)
    ds = cal.period_start_date(idx, "d")
    feb28 = (F.month(ds) == 2) & (F.dayofmonth(ds) == 28)
    before = F.add_months(ds, -12)
    before = F.when(feb28, F.last_day(before)).otherwise(before)
    return F.when(~((F.month(ds) == 2) & (F.dayofmonth(ds) == 29)), F.datediff(ds, before))


def growth_at(hist: Column, t: Column, b0: Column, freq: str) -> Column:
    """12-month growth at a position, NULL in the first season."""
    base = sa.at(hist, t - year_back(b0 + t, freq))
    return F.when(t >= cal.season_length(freq), growth_rate(sa.at(hist, t), base))


def growth_values(hist: Column, b0: Column, freq: str) -> Column:
    """Growth from the first position that has one."""
    p = cal.season_length(freq)
    n = F.size(hist)
    return F.when(
        n > p,
        F.transform(F.sequence(F.lit(p), F.greatest(n - 1, F.lit(p))), lambda t: growth_at(hist, t, b0, freq)),
    ).otherwise(F.array().cast("array<double>"))


def from_growth_values(growth: Column, hist: Column, b0: Column, freq: str) -> Column:
    """Values of growth forecasts that follow ``hist``; beyond a year they build on forecasts."""
    n = F.size(hist)
    whole = F.aggregate(
        growth,
        hist,
        lambda acc, g: F.array_append(
            acc, (1 + g) * sa.at(acc, F.size(acc) - anchor_back(b0 + F.size(acc), freq))
        ),
    )
    return F.slice(whole, n + 1, F.size(growth))


def _trend(hist: Column, t: Column) -> Column:
    return (
        sa.at(hist, t - 2) + 2 * (sa.at(hist, t - 1) + sa.at(hist, t) + sa.at(hist, t + 1)) + sa.at(hist, t + 2)
    ) / 8


def with_seasonal_means(rows: DataFrame) -> DataFrame:
    """Add ``seas``: mean deviation from the trend by position modulo 4, centred on zero."""
    hist = F.col("hist")
    last = F.size(hist) - 3

    def mean_deviation(first: int) -> Column:
        places = F.sequence(F.lit(first), F.greatest(last, F.lit(first)), F.lit(4))
        return sa.array_mean(F.transform(places, lambda t: sa.at(hist, t) - _trend(hist, t)))

    raw = F.array(*[mean_deviation(k) for k in (4, 5, 2, 3)])
    # two steps, so that the four means are computed once and not once per use
    return (
        rows.withColumn("_raw", raw)
        .withColumn("_mean", sa.array_mean(F.col("_raw")))
        .withColumn("seas", F.transform("_raw", lambda v: v - F.col("_mean")))
        .drop("_raw", "_mean")
    )


@dataclass(frozen=True)
class Design:
    """Which numeric features a model uses."""

    freq: str
    growth: bool

    @property
    def n_numeric(self) -> int:
        lags = 1 if self.freq == "y" else (2 if self.growth else 3)
        return lags + 3

    @property
    def first(self) -> int:
        """First position where every lag exists."""
        p = cal.season_length(self.freq)
        dec = DEC_LAG + 2
        if self.growth:
            return max(dec, p + 1 if self.freq == "y" else 2 * p)
        return max(dec, 1 if self.freq == "y" else p + 1)

    def numeric(self, hist: Column, t: Column, b0: Column, seas: Column) -> list[Column]:
        p = cal.season_length(self.freq)
        if self.growth:
            lags = [growth_at(hist, t - 1, b0, self.freq)]
            if self.freq != "y":
                lags.append(growth_at(hist, t - p, b0, self.freq))
        else:
            lags = [sa.at(hist, t - 1)]
            if self.freq != "y":
                recent, base = sa.at(hist, t - p), sa.at(hist, t - p - 1)
                momentum = F.when(t >= 12, growth_rate(recent, base)).otherwise(
                    F.try_divide(recent - base, base)
                )
                lags += [recent, momentum]
        s = t - DEC_LAG
        trend = _trend(hist, s)
        return [
            *lags,
            trend,
            sa.at(seas, t % 4),
            sa.at(hist, s) - trend - sa.at(seas, s % 4),
        ]

    def target(self, hist: Column, t: Column, b0: Column) -> Column:
        return growth_at(hist, t, b0, self.freq) if self.growth else sa.at(hist, t)

    def positions(self, hist: Column) -> Column:
        """Training positions; empty when the history is too short."""
        n = F.size(hist)
        return F.when(
            n > self.first, F.sequence(F.lit(self.first), F.greatest(n - 1, F.lit(self.first)))
        ).otherwise(F.array().cast("array<int>"))
