"""Models by name and the forecast log they produce together."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import panel
from ..operators.skew import hot_join
from ..session import cut_lineage, parallelism
from . import additive, arima, design, failures, native, regression, smoothing, trees

# The model names a job may ask for.
NATIVE = (
    "naive01", "snaive01",
    "sma01", "sma02", "sma03", "wma01", "wma02", "wma03", "ema01", "ema02", "ema03",
)
SMOOTHING = ("expo01", "expo02", "expo03")
LOG_COLUMNS = ["id", "ds", "dsr", "period", "model", "forecast", "time"]


@dataclass(frozen=True)
class Request:
    """What to forecast: the panel, the origins and the horizon."""

    y: DataFrame
    origins: tuple[dt.date, ...]
    freq: str
    h: int
    period_start: int = 0
    x: DataFrame | None = None
    lag: DataFrame | None = None
    options: dict = field(default_factory=dict)

    def history(self) -> DataFrame:
        return panel.history(self.y, self.origins, self.freq)


def spread(df: DataFrame) -> DataFrame:
    """Distribute (id, dsr) rows evenly before a costly fit, whatever the number of series."""
    return df.repartition(parallelism(df.sparkSession), "id", "dsr")


def to_log(rows: DataFrame, forecasts: dict[str, Column], req: Request) -> DataFrame:
    """Explode per-model forecast arrays into forecast-log rows; NULL arrays give none.

    ``time`` is NULL: one Spark stage computes all models together.
    """
    models = F.array(*[F.struct(F.lit(m).alias("model"), f.alias("f")) for m, f in forecasts.items()])
    return (
        rows.select("id", "dsr", "s0", F.explode(models).alias("m"))
        .filter(F.col("m.f").isNotNull() & ~F.exists("m.f", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
        .select("id", "dsr", "s0", F.col("m.model").alias("model"), F.posexplode("m.f").alias("step", "forecast"))
        .select(
            "id",
            cal.period_start_date(F.col("s0") + F.col("step"), req.freq).alias("ds"),
            "dsr",
            (F.col("step") + req.period_start).cast("int").alias("period"),
            "model",
            "forecast",
            F.lit(None).cast("double").alias("time"),
        )
    )


def with_external(rows: DataFrame, req: Request) -> DataFrame:
    """Add ``xs``, the external series of each target as known at the origin, and their ``x_ids``.

    One array per series, laid on the positions of ``hist`` and ``h`` positions beyond, after
    the lag is applied; NULL where there is no value. A target without external series has
    none of them.
    """
    x, lag = req.x, req.lag.select(F.col("id_y").alias("id"), "id_x", F.col("lag").cast("int").alias("lag"))
    packed = panel.pack(x, req.freq, "x").select(F.col("id").alias("id_x"), "b0", "values", "seen")
    per_target = (
        hot_join(lag, packed, ["id_x"], ["id"])
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("id_x", "lag", "b0", "values", "seen"))).alias("_x"))
    )
    o_idx = cal.period_index(F.col("dsr"), req.freq)
    length = F.size("hist") + req.h
    null = F.lit(None).cast("double")

    def known(x):
        last = F.array_max(F.filter(x["seen"], lambda s: s < o_idx))
        return F.slice(x["values"], 1, F.coalesce(last - x["b0"] + 1, F.lit(0)))

    def aligned(x):
        ahead = x["b0"] + x["lag"] - F.col("b0")  # positions before the first value
        vals = known(x)
        core = F.when(
            ahead >= 0, F.concat(F.array_repeat(null, F.greatest(ahead, F.lit(0))), vals)
        ).otherwise(F.slice(vals, F.greatest(1 - ahead, F.lit(1)), F.size(vals)))
        fill = F.array_repeat(null, F.greatest(length - F.size(core), F.lit(0)))
        return F.slice(F.concat(core, fill), 1, length)

    none = F.array().cast(dict(per_target.dtypes)["_x"])
    xs = F.transform(F.coalesce("_x", none), aligned)
    ids = F.transform(F.coalesce("_x", none), lambda x: x["id_x"])
    return rows.join(per_target, "id", "left").withColumns({"xs": xs, "x_ids": ids}).drop("_x")


def needs_x(name: str) -> bool:
    if name in regression.MODELS:
        return regression.MODELS[name][1]
    if name in arima.MODELS:
        return arima.MODELS[name][1]
    return name in trees.MODELS and trees.MODELS[name][2]


def array_models(req: Request, names: Sequence[str]) -> DataFrame:
    """All models that are expressions on a history row, evaluated in one pass."""
    rows = req.history()
    fitted = [n for n in names if n not in NATIVE]
    if any(needs_x(n) for n in fitted):
        rows = with_external(rows, req)
    out: dict[str, Column] = {}
    if fitted:
        rows = spread(rows)
        smooth = [n for n in fitted if n in SMOOTHING]
        if smooth:
            out.update(smoothing.expressions(F.col("hist"), req.h, req.freq, smooth))
        order = req.options.get("order")
        out.update({n: arima.expression(n, req.freq, req.h, order) for n in fitted if n in arima.MODELS})
        linear = [n for n in fitted if n in regression.MODELS]
        if linear:
            rows, exprs = regression.expressions(rows, linear, req.freq, req.h)
            out.update(exprs)
        # the arrays are read once per model below, so they become columns first
        rows = rows.withColumns({f"_f_{n}": e for n, e in out.items()})
        out = {n: F.col(f"_f_{n}") for n in out}
    known = {**native.expressions(F.col("hist"), req.h, req.freq, names), **out}
    return to_log(rows, {n: known[n] for n in names}, req)


def daily_models(req: Request, names: Sequence[str]) -> DataFrame:
    """Models fitted on daily histories."""
    daily = spread(panel.history(req.y, req.origins, "d"))
    f = additive.forecasts(daily, req.freq, req.h)
    return to_log(f, {n: F.col("f") for n in names}, req)


def pooled_models(req: Request, names: Sequence[str]) -> DataFrame:
    """Models trained across series, one fit per origin."""
    rows = req.history()
    if any(needs_x(n) for n in names):
        rows = with_external(rows, req)
    rows = trees.prepared(rows, req.freq, req.h, req.options)
    parts = []
    for n in names:
        f = trees.forecasts(rows, req.origins, n, req.freq, req.h, req.options)
        if f is not None:
            parts.append(to_log(f, {n: F.col("f")}, req))
    return _union(parts) if parts else to_log(rows, {names[0]: F.lit(None).cast("array<double>")}, req)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


FAMILIES = {
    array_models: NATIVE + SMOOTHING + tuple(arima.MODELS) + tuple(regression.MODELS),
    daily_models: additive.MODELS,
    pooled_models: tuple(trees.MODELS),
}
MODELS = tuple(n for names in FAMILIES.values() for n in names)


def input_freq(names: Sequence[str], freq: str) -> str:
    """Frequency the panel must still have for these models: daily for the daily ones."""
    return "d" if any(n in additive.MODELS for n in names) else freq


def forecast(req: Request, names: Sequence[str]) -> DataFrame:
    """Forecast log of all requested models.

    Models with external series give no rows when the request has none. When more than one
    family is asked for, the panel is first summed to the buckets they need and written once.
    """
    names = list(dict.fromkeys(names))
    unknown = [n for n in names if n not in MODELS]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    if req.x is None or req.lag is None:
        usable = [n for n in names if not needs_x(n)]
    else:
        usable = names
    chosen = {b: [n for n in usable if n in family] for b, family in FAMILIES.items()}
    chosen = {b: n for b, n in chosen.items() if n}
    if not chosen:
        none = {"naive01": F.lit(None).cast("array<double>")}
        return to_log(req.history(), none, req)
    if len(chosen) > 1:
        freq = input_freq(names, req.freq)
        req = replace(req, y=cut_lineage(panel.compact(req.y, req.origins, freq)))
    return _union([build(req, n) for build, n in chosen.items()]).select(*LOG_COLUMNS)


def shortest(name: str, freq: str) -> int | None:
    """Periods of history that a model needs, None where the frequency has no season for it."""
    season = cal.season_length(freq)
    if name == "snaive01":
        return season
    if name in SMOOTHING:
        return 2 if name != "expo03" else 2 * season if season > 1 else None
    if name in arima.MODELS:
        growth, with_x, automatic, _ = arima.MODELS[name]
        return arima.MIN_LENGTH[(with_x, automatic)] + (season if growth else 0)
    if name in regression.MODELS:  # two rows whose features reach back
        return max(regression.MIN_BUCKETS, design.Design(freq, regression.MODELS[name][0]).first + 2)
    if name in trees.MODELS:
        return max(8, design.Design(freq, trees.MODELS[name][1]).first + 2)
    return 1


def errors(req: Request, names: Sequence[str], log: DataFrame) -> DataFrame:
    """(id, dsr, model, text) of the requested models that gave a history no forecast, and why."""
    return failures.errors(req.history(), log, {n: shortest(n, req.freq) for n in names})
