"""Panel operators: clipping, gap filling, resampling, origins, as-of histories.

Raw rows are summed per (id, bucket) first. That aggregation combines on the map side,
so a series that holds a large share of all rows still leaves its map tasks as at most
one row per bucket, and everything after it is bounded by the length of the calendar:
a series packed into one array has one DOUBLE per period between its first and last date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import series as sa
from ..session import parallelism


def dates_array(days: Sequence[dt.date]) -> Column:
    return F.array(*[F.lit(d) for d in days])


def series_start(y: DataFrame) -> DataFrame:
    """First date of every series."""
    return y.groupBy("id").agg(F.min("ds").alias("act_st"))


def clip_history(y: DataFrame, origins: Sequence[dt.date]) -> DataFrame:
    """Rows known at each origin: ``ds < dsr``. A series that starts later gives no row."""
    return (
        y.filter(F.col("ds") < F.lit(max(origins)))
        .withColumn("dsr", F.explode(dates_array(origins)))
        .filter(F.col("ds") < F.col("dsr"))
        .select("id", "dsr", *[c for c in y.columns if c != "id"])
    )


def bucket_cells(df: DataFrame, freq: str, value: str = "y") -> DataFrame:
    """SUM of duplicates per (id, bucket), missing values counted as nothing."""
    return df.groupBy("id", cal.period_index(F.col("ds"), freq).cast("int").alias("idx")).agg(
        F.coalesce(F.sum(F.col(value)), sa.zero()).cast("double").alias("v"),
        F.min("ds").alias("first_ds"),
    )


def by_series(cells: DataFrame) -> DataFrame:
    """Hash the aggregated cells by series over all cores.

    This is the exchange the packing needs anyway. Given an explicit width it is not merged
    into a few partitions for being small: the array work behind it is what costs time.
    """
    return cells.repartition(parallelism(cells.sparkSession), "id")


def pack(
    df: DataFrame,
    freq: str,
    value: str = "y",
    start: dt.date | None = None,
    end: dt.date | None = None,
) -> DataFrame:
    """One row per series: ``id, act_st, b0, values, seen`` with gaps as zeros.

    ``seen`` are the period indexes that have rows. ``b0`` is the period index of the first element. ``start`` and ``end`` widen the range
    with zeros but never cut it.
    """
    packed = (
        by_series(bucket_cells(df, freq, value))
        .groupBy("id")
        .agg(
            F.min("first_ds").alias("act_st"),
            F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("cells"),
        )
    )
    first = F.get("cells", F.lit(0))["idx"]
    last = F.element_at("cells", -1)["idx"]
    end_idx = last if end is None else F.greatest(last, F.lit(cal.index_of(end, freq)))
    values = sa.dense_values(F.col("cells"), end_idx)
    b0 = first
    if start is not None:
        b0 = F.least(first, F.lit(cal.index_of(start, freq)))
        values = F.concat(F.array_repeat(sa.zero(), (first - b0).cast("int")), values)
    return packed.select("id", "act_st", b0.alias("b0"), values.alias("values"), F.col("cells.idx").alias("seen"))


def unpack(packed: DataFrame, freq: str, value: str = "y") -> DataFrame:
    """Rows ``id, ds, value`` from packed series."""
    return packed.select("id", "b0", F.posexplode("values").alias("pos", value)).select(
        "id", cal.period_start_date(F.col("b0") + F.col("pos"), freq).alias("ds"), value
    )


def fill_gaps(
    y: DataFrame, start: dt.date | None = None, end: dt.date | None = None, value: str = "y"
) -> DataFrame:
    """Daily rows from the first to the last date of a series, duplicates summed, gaps zero."""
    if start is not None and end is not None and start > end:
        return unpack(pack(y, "d", value), "d", value).limit(0)
    return unpack(pack(y, "d", value, start, end), "d", value)


def resample(y: DataFrame, freq: str, value: str = "y") -> DataFrame:
    """SUM per bucket over the gap-filled series; empty buckets inside its range are zero."""
    return unpack(pack(y, freq, value), freq, value)


def actuals(y: DataFrame, freq: str) -> DataFrame:
    """Observed buckets of each series over its own date range, never extended to an origin."""
    return resample(y, freq)


def resample_x(x: DataFrame, origin: dt.date, freq: str) -> DataFrame:
    """External series known at ``origin``, summed per bucket; no extension to the origin."""
    return resample(x.filter(F.col("ds") < F.lit(origin)), freq, "x")


def origins_frame(spark, test_start: dt.date, test_end: dt.date, freq: str) -> DataFrame:
    """The back-test origins as a DataFrame, produced by Spark from the two dates."""
    shift = test_start.day - 1
    s, e = F.lit(test_start), F.lit(test_end)
    first = cal.horizon_index(s, freq)
    last = cal.period_index(e, freq)
    return (
        spark.range(1)
        .filter(first <= last)
        .select(F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("i"))
        .select(F.date_add(cal.period_start_date(F.col("i"), freq), shift).alias("dsr"))
    )


def horizon(df: DataFrame, h: int, freq: str, period_start: int = 0) -> DataFrame:
    """One row per target bucket: ``h`` bucket starts on or after ``dsr``."""
    first = cal.horizon_index(F.col("dsr"), freq)
    return df.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("step")
    ).select(
        *df.columns,
        cal.period_start_date(first + F.col("step"), freq).alias("ds"),
        (F.col("step") + period_start).cast("int").alias("period"),
    )


def clamp_zero(df: DataFrame, value: str = "y") -> DataFrame:
    """Negative values become zero."""
    return df.withColumn(value, F.greatest(F.col(value), sa.zero()))


def work_units(ids: DataFrame, origins: Sequence[dt.date], models: Sequence[str]) -> DataFrame:
    """Every (id, origin, model) combination, one unit of work each."""
    return (
        ids.select("id")
        .distinct()
        .withColumn("dsr", F.explode(dates_array(origins)))
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    )


def history(y: DataFrame, origins: Sequence[dt.date], freq: str) -> DataFrame:
    """As-of histories: one row per (id, dsr) with everything known at that origin.

    Columns ``id, dsr, b0, hist, s0``: ``hist`` holds the bucket sums from the bucket of the
    first observation through the bucket of the day before ``dsr``, zero-filled; ``s0`` is
    the index of the first forecast bucket. The panel is aggregated and packed once for all
    origins, each origin then only slices the packed array. An origin inside a bucket sees
    the partial sum of that bucket: raw rows are cut at such origins before aggregation.
    """
    last = max(origins)
    mid = [o for o in origins if cal.bucket_of(o, freq) != o]
    y = y.filter(F.col("ds") < F.lit(last))
    if mid:
        packed = _pack_with_cuts(y, mid, last, freq)
    else:
        packed = pack(y, freq, end=last)
    rows = packed.withColumn("dsr", F.explode(dates_array(sorted(set(origins))))).filter(
        F.col("act_st") < F.col("dsr")
    )
    k = (cal.period_index(F.col("dsr"), freq) - F.col("b0")).cast("int")
    hist = F.slice("values", 1, k)
    if mid:
        o_idx = cal.period_index(F.col("dsr"), freq)
        known = F.flatten(
            F.transform(F.filter("cells", lambda c: c["idx"] == o_idx), lambda c: c["segs"])
        )
        partial = F.aggregate(
            F.filter(known, lambda s: s["cut"] < F.col("dsr")),
            sa.zero(),
            lambda acc, s: acc + s["v"],
        )
        aligned = cal.bucket(F.col("dsr"), freq) == F.col("dsr")
        hist = F.when(aligned, hist).otherwise(F.concat(hist, F.array(partial)))
    return rows.select(
        "id", "dsr", "b0", hist.alias("hist"), cal.horizon_index(F.col("dsr"), freq).alias("s0")
    )


def _cut_start(mid: Sequence[dt.date], freq: str) -> Column:
    """Start of the piece of its bucket that a row belongs to, pieces split at ``mid`` origins."""
    ds = F.col("ds")
    start = cal.bucket(ds, freq)
    if not mid:
        return start
    return F.array_max(
        F.array_append(F.filter(dates_array(mid), lambda o: (o <= ds) & (o >= start)), start)
    )


def compact(y: DataFrame, origins: Sequence[dt.date], freq: str, later: bool = False) -> DataFrame:
    """The panel summed as far as the histories at ``origins`` allow; same columns, fewer rows.

    Rows after the last origin are kept only when ``later`` asks for them.
    """
    mid = [o for o in origins if cal.bucket_of(o, freq) != o]
    if not later:
        y = y.filter(F.col("ds") < F.lit(max(origins)))
    return (
        y.groupBy("id", _cut_start(mid, freq).alias("cut"))
        .agg(F.coalesce(F.sum("y"), sa.zero()).alias("y"))
        .select("id", F.col("cut").alias("ds"), "y")
    )


def _pack_with_cuts(y: DataFrame, mid: Sequence[dt.date], last: dt.date, freq: str) -> DataFrame:
    idx = cal.period_index(F.col("ds"), freq).cast("int")
    segments = y.groupBy("id", idx.alias("idx"), _cut_start(mid, freq).alias("cut")).agg(
        F.coalesce(F.sum("y"), sa.zero()).cast("double").alias("v"), F.min("ds").alias("first_ds")
    )
    cells = segments.groupBy("id", "idx").agg(
        F.sum("v").alias("v"),
        F.min("first_ds").alias("first_ds"),
        F.collect_list(F.struct("cut", "v")).alias("segs"),
    )
    packed = by_series(cells).groupBy("id").agg(
        F.min("first_ds").alias("act_st"),
        F.array_sort(F.collect_list(F.struct("idx", "v", "segs"))).alias("cells"),
    )
    end_idx = F.greatest(F.element_at("cells", -1)["idx"], F.lit(cal.index_of(last, freq)))
    return packed.select(
        "id",
        "act_st",
        F.get("cells", F.lit(0))["idx"].alias("b0"),
        sa.dense_values(F.col("cells"), end_idx).alias("values"),
        "cells",
    )
