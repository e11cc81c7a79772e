"""Forecast error measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abs_error(actual: Column, forecast: Column) -> Column:
    return F.abs(actual - forecast)


def ape(actual: Column, forecast: Column) -> Column:
    """Absolute percentage error as a fraction.

    Zero when both are zero, one when only the actual is zero, NULL without an actual.
    """
    return (
        F.when(actual.isNull() | forecast.isNull(), None)
        .when((actual == 0) & (forecast == 0), 0.0)
        .when(actual == 0, 1.0)
        .otherwise(F.abs(F.try_divide(actual - forecast, actual)))
    )


def ensemble_agg(method: str, value: Column) -> Column:
    """Mean or exact median, by configuration name."""
    if method == "mean":
        return F.avg(value)
    if method == "median":
        return F.median(value)
    raise ValueError(f"unknown ensemble method: {method}")
