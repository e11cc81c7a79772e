"""Series that can't be fitted: they get no forecast, and all others keep theirs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_FINITE = "the history has values that are not finite"
NO_SEASON = "the model needs a frequency with seasons"
NO_FIT = "the fit gave no finite forecast"


def errors(histories: DataFrame, log: DataFrame, shortest: Mapping[str, int | None]) -> DataFrame:
    """(id, dsr, model, text) of every requested model that gave a history no forecast, with the reason.

    ``shortest`` has the requested models and the periods that each needs, None where no history would do. ``histories`` has a
    row per (id, dsr); the join is one on equal keys of both.
    """
    needs = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(n).cast("int").alias("need")) for m, n in shortest.items()])
    bad = F.exists("hist", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    asked = histories.select("id", "dsr", F.size("hist").alias("n"), bad.alias("bad"), F.explode(needs).alias("m")).select("id", "dsr", "n", "bad", "m.*")
    given = log.select("id", "dsr", "model").distinct()
    text = (
        F.when(F.col("need").isNull(), NO_SEASON)
        .when(F.col("bad"), NOT_FINITE)
        .when(F.col("n") < F.col("need"), F.concat(F.lit("history of "), F.col("n"), F.lit(" periods, the model needs "), F.col("need")))
        .otherwise(NO_FIT)
    )
    return asked.join(given, ["id", "dsr", "model"], "left_anti").select("id", "dsr", "model", text.alias("text"))
