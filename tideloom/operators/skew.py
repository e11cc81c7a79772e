"""Joins that survive a key with a very large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000  # rows of one key that a single task may take


def hot_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    count: DataFrame | None = None,
) -> DataFrame:
    """Inner or left join with the hot keys of ``left`` salted.

    A key with more than ``hot_rows`` rows is split into as many parts as it needs, by a hash
    of ``spread_by``; the matching rows of ``right`` are copied once per part. How the list of hot
    keys, at most one per ``hot_rows`` counted rows, is joined is left to Catalyst. ``count`` is a smaller
    table to count the keys on, where its rows per key tell those of ``left``; it may lack some
    of the keys.
    """
    keys = list(keys)
    counted = left if count is None else count
    known = [k for k in keys if k in counted.columns]
    hot = (
        counted.groupBy(*known)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*known, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    )
    hashed = F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = left.join(hot, known, "left").withColumn("_salt", hashed).drop("_parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    copied = right.join(hot, known, "left").withColumn("_salt", copies).drop("_parts")
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")
