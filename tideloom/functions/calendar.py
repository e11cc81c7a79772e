"""Calendar arithmetic on DATE columns for the four bucket frequencies.

Every bucket has an integer *period index* (days since 1970, or months, quarters,
years since year 0), so distances, shifts and gap lengths are plain integer
arithmetic inside whole-stage codegen and no calendar table is ever joined.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Freq:
    unit: str  # unit understood by F.trunc
    months: int  # calendar months per period, 0 for days
    season: int  # periods in a seasonal cycle


# Bucket unit, months per period and seasonal length by frequency.
FREQS = {
    "d": Freq("day", 0, 365),
    "m": Freq("month", 1, 12),
    "q": Freq("quarter", 3, 4),
    "y": Freq("year", 12, 1),
}


def season_length(freq: str) -> int:
    return FREQS[freq].season


def bucket(ds: Column, freq: str) -> Column:
    """First day of the period that contains ``ds``."""
    if freq == "d":
        return ds.cast("date")
    return F.trunc(ds, FREQS[freq].unit)


def period_index(ds: Column, freq: str) -> Column:
    """Integer position of ``ds`` on the period axis; consecutive periods differ by 1."""
    if freq == "d":
        return F.unix_date(ds)
    if freq == "m":
        return F.year(ds) * 12 + F.month(ds) - 1
    if freq == "q":
        return F.year(ds) * 4 + F.quarter(ds) - 1
    return F.year(ds)


def period_start_date(idx: Column, freq: str) -> Column:
    """Inverse of :func:`period_index`: the first day of the period."""
    if freq == "d":
        return F.date_from_unix_date(idx.cast("int"))
    if freq == "y":
        return F.make_date(idx.cast("int"), F.lit(1), F.lit(1))
    per_year = FREQS[freq].season
    year = F.floor(idx / per_year).cast("int")
    month = (F.pmod(idx, F.lit(per_year)) * FREQS[freq].months + 1).cast("int")
    return F.make_date(year, month, F.lit(1))


def shift_period(ds: Column, n: Column | int, freq: str) -> Column:
    """``ds`` moved by ``n`` periods; month ends are clamped (31 Jan + 1 month = 28/29 Feb)."""
    n = n if isinstance(n, Column) else F.lit(n)
    n = n.cast("int")
    if freq == "d":
        return F.date_add(ds, n)
    return F.add_months(ds, n * FREQS[freq].months)


def horizon_index(origin: Column, freq: str) -> Column:
    """Index of the first bucket that starts on or after ``origin``."""
    b = bucket(origin, freq)
    return period_index(origin, freq) + F.when(b == origin, 0).otherwise(1)


# -- the same arithmetic for plain dates, used on job parameters only ---------------


def bucket_of(day: dt.date, freq: str) -> dt.date:
    if freq == "d":
        return day
    if freq == "m":
        return day.replace(day=1)
    if freq == "q":
        return day.replace(month=(day.month - 1) // 3 * 3 + 1, day=1)
    return day.replace(month=1, day=1)


def index_of(day: dt.date, freq: str) -> int:
    if freq == "d":
        return (day - dt.date(1970, 1, 1)).days
    if freq == "m":
        return day.year * 12 + day.month - 1
    if freq == "q":
        return day.year * 4 + (day.month - 1) // 3
    return day.year


def date_of(idx: int, freq: str) -> dt.date:
    if freq == "d":
        return dt.date(1970, 1, 1) + dt.timedelta(days=idx)
    if freq == "y":
        return dt.date(idx, 1, 1)
    per_year, step = FREQS[freq].season, FREQS[freq].months
    return dt.date(idx // per_year, idx % per_year * step + 1, 1)


def rolling_origins(test_start: dt.date, test_end: dt.date, freq: str) -> list[dt.date]:
    """Forecast origins of a back-test.

    Bucket starts inside [test_start, test_end], each moved by the day of month of
    ``test_start`` minus one. A mid-month start therefore skips its own month and may
    end after ``test_end``; daily origins get the same offset.
    """
    first = index_of(test_start, freq)
    if bucket_of(test_start, freq) != test_start:
        first += 1
    last = index_of(test_end, freq)
    offset = dt.timedelta(days=test_start.day - 1)
    return [date_of(i, freq) + offset for i in range(first, last + 1)]
