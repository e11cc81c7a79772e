"""Readers and writers for the table roles: CSV with a header, or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .roles import ROLES, check_schema


def _typed(df: DataFrame, role: str) -> DataFrame:
    """Role columns by name, extras dropped, cast; NaN becomes NULL."""
    source = dict(df.dtypes)
    cols = []
    for name, kind in ROLES[role].items():
        c = F.col(name)
        if kind == "date" and source[name] == "string":
            c = F.to_date(c, "yyyy-MM-dd")
        elif kind == "int" and source[name] == "string":
            c = c.cast("double").cast("int")
        else:
            c = c.cast(kind)
        if kind == "double":
            c = F.when(~F.isnan(c), c)
        cols.append(c.alias(name))
    return df.select(*cols)


def _raw(spark: SparkSession, path: str, fmt: str | None) -> DataFrame:
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        # columns are matched by name, so the header decides, not the position
        return spark.read.option("header", True).option("encoding", "utf-8").csv(path)
    return spark.read.format(fmt).load(path)


def read_role(spark: SparkSession, path: str, role: str, fmt: str | None = None) -> DataFrame:
    """Read a table of a role. A value that does not fit its type is an error."""
    return _typed(_raw(spark, path, fmt), role)


class SchemaError(ValueError):
    """Names every column that is missing or holds values of another type, with their number."""


def read_checked(spark: SparkSession, path: str, role: str, fmt: str | None = None) -> DataFrame:
    """Read a table of a role after one pass that checks every value of it."""
    raw = _raw(spark, path, fmt)
    wrong = [r for r in check_schema(raw, role).collect() if not r["present"] or r["bad"]]
    if wrong:
        told = [f"{r['column']}: " + (f"{r['bad']} values aren't {r['type']}" if r["present"] else "missing") for r in wrong]
        raise SchemaError(f"{path} as {role}: {'; '.join(told)}")
    return _typed(raw, role)


def read_y(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return read_role(spark, path, "y", fmt)


def read_x(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return read_role(spark, path, "x", fmt)


def read_lag(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return read_role(spark, path, "lag", fmt)


def read_forecastlog(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return read_role(spark, path, "forecastlog", fmt)


def _csv_ready(df: DataFrame) -> DataFrame:
    """CSV has no array type: lists become JSON text."""
    arrays = [n for n, t in df.dtypes if t.startswith("array")]
    return df.withColumns({n: F.to_json(n) for n in arrays}) if arrays else df


def write_parts(df: DataFrame, path: str, partition_by: str = "dsr") -> None:
    """Partitioned Parquet, one directory per origin; replaces one file per chunk of series."""
    df.write.mode("overwrite").partitionBy(partition_by).parquet(path)


def write_output(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The final table of a job, written in parallel."""
    w = (_csv_ready(df) if fmt == "csv" else df).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        w.format(fmt).save(path)


def union_log(new: DataFrame, old: DataFrame, start) -> DataFrame:
    """New log rows together with the history before ``start``."""
    return new.unionByName(old.filter(F.col("dsr") < F.lit(start)))
