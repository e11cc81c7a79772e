"""Ranking of models by back-test error and ensembles of the best.

Nothing loops over origins: the rank origin is a key. The only broadcast tables are the
distinct origins of the log and the (origin, period) pairs with an actual; both are counts
of calendar dates, not of series.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.errors import abs_error, ape, ensemble_agg

RANK_COLUMNS = ["id", "dsr", "period", "rank", "model", "error", "test_back"]
FORECAST_COLUMNS = ["id", "ds", "dsr", "period", "forecast", "error", "top_model", "test_back"]


def score_log(log: DataFrame, actual: DataFrame) -> DataFrame:
    """Forecast log with ``actual``, ``mae`` and ``mape``; rows without an actual stay."""
    act = actual.select("id", "ds", F.col("y").alias("actual"))
    return log.join(act, ["id", "ds"], "left").withColumns(
        {
            "mae": abs_error(F.col("actual"), F.col("forecast")),
            "mape": ape(F.col("actual"), F.col("forecast")),
        }
    )


def rank_models(
    log: DataFrame,
    actual: DataFrame,
    freq: str,
    test_back: int = 6,
    error_ens: str = "mean",
    error_dsp: str = "mape",
    rank_by: str = "mae",
    only: dt.date | None = None,
) -> DataFrame:
    """Dense rank of the models per (id, period) at every rank origin.

    A rank origin is one period after a log origin. It sees log rows with ``dsr`` before it and
    ``ds`` not older than ``test_back`` periods, and actuals dated before it. ``only`` asks for
    a single rank origin and lets the scan of the log skip everything older.
    """
    index = lambda c: cal.period_index(F.col(c), freq)
    dates = log.select("dsr")
    if only is not None:
        day = F.lit(only)
        since = cal.shift_period(day, -test_back, freq)
        # one period back, and the days by which clamped month ends can differ
        dates = dates.filter((F.col("dsr") < day) & (F.col("dsr") >= F.date_sub(cal.shift_period(day, -1, freq), 3)))
        log = log.filter((F.col("dsr") < day) & (F.col("ds") >= since))
        actual = actual.filter((F.col("ds") < day) & (F.col("ds") >= since))
    origins = (
        dates.distinct()
        .select(cal.shift_period(F.col("dsr"), 1, freq).alias("rank_dsr")).distinct()
        .withColumn("since", cal.shift_period(F.col("rank_dsr"), -test_back, freq))
    )
    if only is not None:
        origins = origins.filter(F.col("rank_dsr") == day)
    scored = score_log(log.select("id", "ds", "dsr", "period", "model", "forecast"), actual)
    # The log crosses the network once, as it is: a (series, period) holds at most one row per origin and model, and meets
    # its rank origins after the exchange, which also serves the aggregation and the rank.
    placed = scored.repartition("id", "period")
    # a rank origin lies in a period from that of dsr to test_back after that of ds: equal keys, no range join
    first, last = index("dsr"), index("ds") + test_back
    seen = (
        placed.filter(last >= first)
        .withColumn("_at", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        .join(F.broadcast(origins.withColumn("_at", index("rank_dsr").cast("int"))), "_at")
        .filter((F.col("dsr") < F.col("rank_dsr")) & (F.col("ds") >= F.col("since")))
        .drop("_at")
    )
    known = (F.col("ds") < F.col("rank_dsr")) & F.col("actual").isNotNull()
    per_model = seen.groupBy("id", "rank_dsr", "period", "model").agg(
        ensemble_agg(error_ens, F.when(known, F.col("mae"))).alias("mae"),
        ensemble_agg(error_ens, F.when(known, F.col("mape"))).alias("mape"),
        F.nullif(F.count_if(known), F.lit(0)).alias("test_back"),
    )
    # (origin, period) pairs for which no series at all has an actual: every model ranks first.
    # It asks for all columns of the aggregate, so that both uses share one exchange.
    known_any = F.coalesce(F.col("test_back").cast("double"), "mae", "mape").isNotNull()
    evidence = per_model.groupBy("rank_dsr", "period").agg(F.max(known_any).alias("_any"))
    w = Window.partitionBy("id", "rank_dsr", "period").orderBy(F.asc_nulls_last(rank_by))
    return (
        per_model.withColumn("_rank", F.dense_rank().over(w))
        .join(F.broadcast(evidence), ["rank_dsr", "period"])
        .select(
            "id",
            F.col("rank_dsr").alias("dsr"),
            "period",
            F.when(~F.col("_any"), F.lit(1))
            .when(F.col(rank_by).isNotNull(), F.col("_rank"))
            .alias("rank"),
            "model",
            F.col(error_dsp).alias("error"),
            "test_back",
        )
    )


def ensemble(
    fc: DataFrame,
    rank: DataFrame,
    top_model: int = 3,
    fcst_ens: str = "mean",
    error_ens: str = "mean",
) -> DataFrame:
    """Combine the ``top_model`` best models per (id, dsr, period).

    Ranks are made dense again among the models present. A series without any rank at an
    origin uses all its models. Ties keep more than ``top_model``.
    """
    cells = fc.select("id", "ds", "dsr", "period", "model", "forecast").join(
        rank.select("id", "dsr", "period", "model", "rank", "error", "test_back"),
        ["id", "dsr", "period", "model"],
        "left",
    )
    series = Window.partitionBy("id", "dsr")
    place = Window.partitionBy("id", "dsr", "period").orderBy(F.asc_nulls_last("rank"))
    return (
        cells.withColumn("_ranked", F.count("rank").over(series) > 0)
        .withColumn("_place", F.when(F.col("rank").isNotNull(), F.dense_rank().over(place)))
        .withColumn("_place", F.when(F.col("_ranked"), F.col("_place")).otherwise(F.lit(1)))
        .filter(F.col("_place") <= top_model)
        .groupBy("id", "ds", "dsr", "period")
        .agg(
            ensemble_agg(fcst_ens, F.col("forecast")).alias("forecast"),
            ensemble_agg(error_ens, F.col("error")).alias("error"),
            F.transform(
                F.array_sort(F.collect_list(F.struct("_place", "model"))), lambda s: s["model"]
            ).alias("top_model"),
            F.avg("test_back").alias("test_back"),
        )
        .select(*FORECAST_COLUMNS)
    )


def ensemble_log(log: DataFrame, rank: DataFrame, **kw) -> DataFrame:
    """The ensemble for every origin of the log at once; ``dsr`` is part of every key."""
    return ensemble(log, rank, **kw)


def evaluate(log: DataFrame, ens: DataFrame, actual: DataFrame, top_model: int = 3) -> DataFrame:
    """Forecasts of the models, of the ensemble, and the actuals, in one table."""
    single = score_log(log, actual).withColumns(
        {"y": F.col("forecast"), "y_type": F.lit("forecast")}
    )
    combined = score_log(ens.drop("error"), actual).withColumns(
        {"model": F.lit(f"top{top_model}"), "y": F.col("forecast"), "y_type": F.lit("forecast")}
    )
    observed = actual.select("id", "ds", "y").withColumn("y_type", F.lit("actual"))
    out = [
        "id", "ds", "dsr", "period", "model", "forecast", "actual", "mae", "mape",
        "top_model", "test_back", "y", "y_type",
    ]
    return (
        single.unionByName(combined, allowMissingColumns=True)
        .unionByName(observed, allowMissingColumns=True)
        .select(*out)
    )
