"""Roles of the input and output tables and their checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns and types by role.
ROLES = {
    "y": {"id": "string", "ds": "date", "y": "double"},
    "x": {"id": "string", "ds": "date", "x": "double"},
    "lag": {"id_y": "string", "id_x": "string", "lag": "int"},
    "forecastlog": {
        "id": "string", "ds": "date", "dsr": "date", "period": "int",
        "model": "string", "forecast": "double", "time": "double",
    },
}

# Required and optional roles by job.
JOB_ROLES = {
    "forecast-init": ({"y"}, {"x", "lag"}),
    "forecast-prod": ({"y", "forecastlog"}, {"x", "lag"}),
    "feat-selection": ({"y", "x"}, set()),
}


def check_schema(df: DataFrame, role: str) -> DataFrame:
    """One row per column of the role: ``column, type, present, bad``.

    ``bad`` counts values that do not cast to the declared type, in one pass over the data.
    Dates must read as yyyy-MM-dd and are checked like everything else.
    """
    spec = ROLES[role]

    def bad(name: str, kind: str):
        if name not in df.columns:
            return F.lit(None).cast("bigint")
        c = F.col(name)
        source = dict(df.dtypes)[name]
        if kind == "int":  # whole numbers may be written as 2.0
            n = c.try_cast("double")
            ok = n.isNotNull() & (n == F.floor(n))
        elif kind == "date" and source == "string":
            ok = F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull()
        else:
            ok = c.try_cast(kind).isNotNull()
        return F.count_if(c.isNotNull() & ~ok)

    # one aggregate row, turned into one row per column
    counts = df.agg(*[bad(n, k).alias(n) for n, k in spec.items()])
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"),
                F.lit(k).alias("type"),
                F.lit(n in df.columns).alias("present"),
                F.col(n).alias("bad"),
            )
            for n, k in spec.items()
        ]
    )
    return counts.select(F.inline(rows))


def schema_ok(df: DataFrame, role: str) -> bool:
    """True when every column of the role exists and casts."""
    if not set(ROLES[role]) <= set(df.columns):
        return False
    return check_schema(df, role).filter(F.col("bad") > 0).isEmpty()


def check_files(job: str, present: Iterable[str]) -> None:
    """All required roles, and of the optional ones all or none (x and lag travel together)."""
    required, optional = JOB_ROLES[job]
    given = set(present)
    missing = required - given
    if missing:
        raise ValueError(f"{job} needs {sorted(missing)}")
    some = given & optional
    if some and some != optional:
        raise ValueError(f"{job} needs {sorted(optional - some)} together with {sorted(some)}")
