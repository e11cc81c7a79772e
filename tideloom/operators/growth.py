"""Growth transforms: value to 12-month growth, growth back to value, row-lag growth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal


def growth_rate(value: Column, base: Column) -> Column:
    """(value - base) / base with +inf -> 1, -inf -> -1 and 0/0 or missing -> 1."""
    return (
        F.when(value.isNull() | base.isNull(), 1.0)
        .when(base != 0, F.try_divide(value - base, base))
        .when(value < 0, -1.0)
        .otherwise(1.0)
    )


def _year_ago(value: str, keys: Sequence[str], freq: str) -> Column:
    """Value exactly 12 calendar months earlier by RANGE frame, no self-join."""
    col = F.col(value)
    w = Window.partitionBy(*keys).orderBy(cal.period_index(F.col("ds"), freq))
    if freq != "d":
        n = 12 // cal.FREQS[freq].months
        return F.first(col).over(w.rangeBetween(-n, -n))
    days = F.datediff(F.col("ds"), F.add_months(F.col("ds"), -12))
    return F.when(days == 365, F.first(col).over(w.rangeBetween(-365, -365))).otherwise(
        F.first(col).over(w.rangeBetween(-366, -366))
    )


def to_growth(
    df: DataFrame, freq: str, value: str = "y", out: str = "gr", keys: Sequence[str] = ("id",)
) -> DataFrame:
    """12-month growth of a bucketed panel (12 months for every frequency).

    Rows before one seasonal length stay as computed (NULL without a base); from there on
    infinite or missing growth is replaced.
    """
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("ds"))
    return (
        df.withColumn("_base", _year_ago(value, keys, freq))
        .withColumn("_rn", rn)
        .withColumn(
            out,
            F.when(F.col("_rn") > cal.season_length(freq), growth_rate(F.col(value), F.col("_base")))
            .otherwise(F.try_divide(F.col(value) - F.col("_base"), F.col("_base"))),
        )
        .drop("_base", "_rn")
    )


def from_growth(
    fc: DataFrame,
    act: DataFrame,
    h: int,
    freq: str,
    growth: str = "g",
    value: str = "y",
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Growth forecasts back to values: (1 + g) times the value 12 months earlier.

    The base is the actual, or beyond 12 months the forecast of a year earlier. The chain is
    as deep as the horizon needs and no deeper; without a base the value is NULL. ``keys``
    are the keys of ``fc``; ``act`` is joined on those of them that it has.
    """
    on = [k for k in keys if k in act.columns]
    shifted = act.select(*on, F.add_months("ds", 12).alias("ds"), F.col("ds").alias("_src"), value)
    base = shifted.groupBy(*on, "ds").agg(F.max_by(value, "_src").alias("_base"))
    if freq != "d":  # buckets never collide when moved by a year
        base = shifted.select(*on, "ds", F.col(value).alias("_base"))
    months = h * cal.FREQS[freq].months if freq != "d" else -(-h // 28)
    out = fc.join(base, [*on, "ds"], "left").withColumn(
        value, (1 + F.col(growth)) * F.col("_base")
    )
    for _ in range(max(-(-months // 12) - 1, 0)):
        prev = out.select(
            *keys, F.add_months("ds", 12).alias("ds"), F.col(value).alias("_prev")
        ).filter(F.col("_prev").isNotNull())
        out = (
            out.join(prev, [*keys, "ds"], "left")
            .withColumn(value, F.coalesce(F.col(value), (1 + F.col(growth)) * F.col("_prev")))
            .drop("_prev")
        )
    return out.drop("_base")


def pct_change(
    df: DataFrame, freq: str, value: str = "x", keys: Sequence[str] = ("id",)
) -> DataFrame:
    """Growth over one seasonal length of *rows*; the first season of rows is dropped."""
    n = cal.season_length(freq)
    w = Window.partitionBy(*keys).orderBy("ds")
    return (
        df.withColumn("_base", F.lag(value, n).over(w))
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") > n)
        .withColumn(value, growth_rate(F.col(value), F.col("_base")))
        .drop("_base", "_rn")
    )
