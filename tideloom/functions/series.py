"""Helpers on dense series arrays (one DOUBLE per consecutive period, oldest first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0.0)


def dense_values(cells: Column, end_idx: Column) -> Column:
    """Zero-filled array from sorted ``array<struct<idx, v>>`` cells through ``end_idx``.

    Each cell emits its value and the zeros up to the next cell, so the fill is linear
    in the length of the result and needs no calendar spine or join.
    """
    return F.flatten(
        F.transform(
            cells,
            lambda c, i: F.concat(
                F.array(c["v"]),
                F.array_repeat(
                    zero(),
                    (F.coalesce(F.get(cells, i + 1)["idx"], end_idx + 1) - c["idx"] - 1).cast("int"),
                ),
            ),
        )
    )


def at(values: Column, pos: Column | int) -> Column:
    """Zero-based access, NULL outside the array."""
    pos = pos if isinstance(pos, Column) else F.lit(pos)
    return F.get(values, pos.cast("int"))


def tail(values: Column, n: int) -> Column:
    """The last ``n`` values (all of them when the array is shorter)."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, zero(), lambda acc, v: acc + F.coalesce(v, zero()))


def array_mean(values: Column) -> Column:
    return F.try_divide(array_sum(values), F.size(values).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))
