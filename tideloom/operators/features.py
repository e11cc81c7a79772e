"""Feature engineering on bucketed panels, one window sort per series key."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from . import growth, panel
from .skew import hot_join

# Domains of the calendar dummies.
PART_DOMAINS = {
    "day": range(1, 32),
    "dayofyear": range(1, 367),
    "weekofyear": range(1, 54),
    "weekday": range(0, 7),
    "month": range(1, 13),
    "quarter": range(1, 5),
}

# Feature prefixes by frequency for the nominal models.
NOMINAL_FEATURES = {
    "d": ("day_", "dayofyear_", "weekofyear_", "weekday_", "month_", "quarter_", "last_", "dec_"),
    "m": ("month_", "quarter_", "last_", "dec_"),
    "q": ("quarter_", "last_", "dec_"),
    "y": ("last_period", "dec_"),
}


def feature_set(freq: str, growth_model: bool = False, external: bool = False) -> tuple[str, ...]:
    """Feature prefixes of a model: growth models swap the value lags for growth lags."""
    names = NOMINAL_FEATURES[freq]
    if growth_model:
        names = tuple(n.replace("last_", "lastgr_") for n in names)
    return names + (("x_",) if external else ())


def _series(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("ds")


def extend(act: DataFrame, fc: DataFrame, freq: str) -> DataFrame:
    """Append forecast rows outside the actual range of each series, refill and rebucket."""
    span = act.groupBy("id").agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi"))
    outside = (
        fc.join(span, "id")
        .filter((F.col("ds") < F.col("_lo")) | (F.col("ds") > F.col("_hi")))
        .select("id", "ds", "y")
    )
    return panel.resample(act.select("id", "ds", "y").unionByName(outside), freq)


def date_parts(df: DataFrame) -> DataFrame:
    ds = F.col("ds")
    return df.withColumns(
        {
            "day": F.dayofmonth(ds),
            "dayofyear": F.dayofyear(ds),
            "weekofyear": F.weekofyear(ds),
            "weekday": F.weekday(ds),
            "month": F.month(ds),
            "quarter": F.quarter(ds),
            "year": F.year(ds),
        }
    )


def one_hot(df: DataFrame, part: str) -> DataFrame:
    """0/1 columns ``part_k`` over the fixed domain of ``part``, so all frames agree in width."""
    cols = {f"{part}_{k}": (F.col(part) == k).cast("int") for k in PART_DOMAINS[part]}
    return df.withColumns(cols).drop(part)


def last_values(df: DataFrame, freq: str, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Lags 1 and one season of y, and the momentum of the season before."""
    p = cal.season_length(freq)
    w = _series(keys)
    base = F.lag("y", p + 1).over(w)
    recent = F.lag("y", p).over(w)
    rn = F.row_number().over(w)
    return (
        df.withColumns(
            {
                "last_period": F.lag("y", 1).over(w),
                "last_year": recent,
                "_base": base,
                "_rn": rn,
            }
        )
        .withColumn(
            "last_momentum",
            # replacement starts at row 13 for every frequency
            F.when(F.col("_rn") > 12, growth.growth_rate(F.col("last_year"), F.col("_base")))
            .otherwise(F.try_divide(F.col("last_year") - F.col("_base"), F.col("_base"))),
        )
        .drop("_base", "_rn")
    )


def last_growth(df: DataFrame, freq: str, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Lags 1 and one season of the 12-month growth."""
    w = _series(keys)
    g = growth.to_growth(df, freq, keys=keys)
    return g.withColumns(
        {
            "lastgr_period": F.lag("gr", 1).over(w),
            "lastgr_year": F.lag("gr", cal.season_length(freq)).over(w),
        }
    )


def decompose(df: DataFrame, lag: int = 3, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Additive decomposition with period 4: ``dec_trend``, ``dec_seasonal``, ``dec_residual``.

    The trend is a centred 2x4 moving average, the seasonal part the mean deviation by
    row position modulo 4, centred on zero. Trend and residual come lagged: with ``lag=2``
    the centred filter still reaches the current row, ``lag=3`` uses earlier rows only.
    """
    w = _series(keys)
    cycle = Window.partitionBy(*keys, "_phase")
    whole = Window.partitionBy(*keys)
    y = F.col("y")
    trend = (
        0.125 * F.lag("y", 2).over(w)
        + 0.25 * (F.lag("y", 1).over(w) + y + F.lead("y", 1).over(w))
        + 0.125 * F.lead("y", 2).over(w)
    )
    d = df.withColumn("_rn", F.row_number().over(w)).withColumn("_trend", trend)
    d = d.withColumn("_phase", F.pmod(F.col("_rn") - 1, F.lit(4)))
    d = d.withColumn("_dev", F.avg(y - F.col("_trend")).over(cycle))
    d = d.withColumn("_mean", F.avg(F.when(F.col("_rn") <= 4, F.col("_dev"))).over(whole))
    d = d.withColumn("dec_seasonal", F.col("_dev") - F.col("_mean"))
    d = d.withColumn("_resid", y - F.col("_trend") - F.col("dec_seasonal"))
    d = d.withColumn("dec_trend", F.lag("_trend", lag).over(w))
    d = d.withColumn("dec_residual", F.lag("_resid", lag).over(w))
    return d.drop("_rn", "_trend", "_phase", "_dev", "_mean", "_resid")


def _lagged(df: DataFrame, x: DataFrame, shifts: DataFrame, freq: str, out: str) -> DataFrame:
    """Left join of x moved forward by ``shift`` periods: one row per (id, ds, id_x).

    The join key is (id_x, source bucket), which spreads an external series over its dates;
    one that is used by very many targets is split further.
    """
    wide = df.join(shifts.select(F.col("id_y").alias("id"), "id_x", "shift"), "id")
    src = wide.withColumn("_src", cal.shift_period(F.col("ds"), -F.col("shift"), freq))
    values = x.select(F.col("id").alias("id_x"), F.col("ds").alias("_src"), F.col("x").alias(out))
    return hot_join(src, values, ["id_x", "_src"], ["id"], "left", count=shifts).drop("_src", "shift")


def join_x_lagged(df: DataFrame, x: DataFrame, lag: DataFrame, freq: str) -> DataFrame:
    """Panel with each of its external series shifted forward by its lag, in long form."""
    shifts = lag.select("id_y", "id_x", F.col("lag").cast("int").alias("shift"))
    return _lagged(df, x, shifts, freq, "x")


def join_x_rnn(
    df: DataFrame, x: DataFrame, lag: DataFrame, origin: dt.date, freq: str, delay: int = 3
) -> DataFrame:
    """As :func:`join_x_lagged`, shifted so that the latest x reaches the origin (at least ``delay``)."""
    last = x.groupBy(F.col("id").alias("id_x")).agg(F.max("ds").alias("_last"))
    periods = F.lit(cal.index_of(origin, freq)) - cal.period_index(F.col("_last"), freq)
    shifts = (
        hot_join(lag.select("id_y", "id_x"), last, ["id_x"], ["id_y"])
        .select("id_y", "id_x", F.greatest(periods, F.lit(delay)).cast("int").alias("shift"))
    )
    return _lagged(df, x, shifts, freq, "xrnn")


def select_features(
    df: DataFrame,
    prefixes: Sequence[str],
    start: dt.date | None = None,
    end: dt.date | None = None,
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Keys, ds, y and every column that starts with one of ``prefixes``, rows in [start, end]."""
    fixed = [*keys, "ds", "y"]
    cols = [c for c in df.columns if c not in fixed and c.startswith(tuple(prefixes))]
    if start is not None:
        df = df.filter(F.col("ds") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("ds") <= F.lit(end))
    return df.select(*fixed, *cols)


def _train_only(is_train: Column | None, c: str) -> Column:
    return F.col(c) if is_train is None else F.when(is_train, F.col(c))


def standardize(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("id",), is_train: Column | None = None
) -> DataFrame:
    """z-scores with population deviation, fitted on the training rows; a constant is left at 0."""
    w = Window.partitionBy(*keys)
    out = {}
    for c in cols:
        v = _train_only(is_train, c)
        sd = F.stddev_pop(v).over(w)
        out[c] = (F.col(c) - F.avg(v).over(w)) / F.when(sd == 0, 1.0).otherwise(sd)
    return df.withColumns(out)


def minmax_scale(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("id",), is_train: Column | None = None
) -> DataFrame:
    """Scale to the training range; ``<col>_min`` and ``<col>_range`` allow the inverse."""
    w = Window.partitionBy(*keys)
    out = {}
    for c in cols:
        v = _train_only(is_train, c)
        lo, span = F.min(v).over(w), F.max(v).over(w) - F.min(v).over(w)
        out[f"{c}_min"] = lo
        out[f"{c}_range"] = F.when(span == 0, 1.0).otherwise(span)
    d = df.withColumns(out)
    return d.withColumns({c: (F.col(c) - F.col(f"{c}_min")) / F.col(f"{c}_range") for c in cols})


def minmax_inverse(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.col(c) * F.col(f"{c}_range") + F.col(f"{c}_min"))


def sequence_windows(
    df: DataFrame,
    features: Sequence[str],
    look_back: int,
    forward: int,
    n_val: int,
    keys: Sequence[str] = ("id",),
) -> DataFrame:
    """Rolling (look_back x features) inputs with the next ``forward`` values of y as target.

    ``part`` is ``train`` for windows that end before the last ``n_val`` rows and ``val`` for
    windows inside the last ``n_val + look_back + forward - 1`` rows; a window that lies in
    both row ranges gives two rows. Series too short for a validation tail give none.
    """
    w = _series(keys)
    len_val = n_val + look_back + forward - 1
    inputs = F.collect_list(F.array(*[F.col(c).cast("double") for c in features]))
    d = df.withColumns(
        {
            "inputs": inputs.over(w.rowsBetween(-(look_back - 1), 0)),
            "target": F.collect_list(F.col("y")).over(w.rowsBetween(1, forward)),
            "_from_end": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ds"))),
            "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        }
    ).filter(
        (F.size("inputs") == look_back) & (F.size("target") == forward) & (F.col("_n") > len_val)
    )
    last_target = F.col("_from_end") - forward
    first_input = F.col("_from_end") + look_back - 1
    parts = F.array_compact(
        F.array(
            F.when(last_target > n_val, F.lit("train")),
            F.when(first_input <= len_val, F.lit("val")),
        )
    )
    return d.select(*keys, "ds", F.explode(parts).alias("part"), "inputs", "target")
