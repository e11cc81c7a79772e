"""The back-test from files to files, in parts that a later run doesn't repeat.

A part is one Spark write: the panel summed to buckets, the forecasts of a hash range of series, the pooled
models of an origin, an output. When its write has ended, its name goes to a manifest beside it. A run that was lost, driver included,
is started again with the same arguments: it skips what the manifest names and writes everything else
anew over whatever the lost run has left of it. Lost executors are Spark's matter, inside a part.

Parts belong to a job: the hash of parameters, inputs and part layout. Other parameters or other inputs are another job with a folder of its
own, so nothing stale is ever taken over. Two runs of the same job at the same time aren't supported. The work
folder must be one that driver and executors share; it stays after the job, and can be removed when the outputs are there.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import calendar as cal
from ..models import registry
from ..operators import accuracy, panel
from ..sources import io
from ..sources.config import InitConfig, parse_config
from ..sources.roles import check_files

BUCKETS = 16  # hash ranges of series: what a lost run repeats at most is one range of one family of models
OUTPUTS = ("forecastlog", "forecast", "evaluate", "errors")


@dataclass(frozen=True)
class Parts:
    """Written parts of one job and the manifest of those that are whole."""

    spark: SparkSession
    folder: str

    @property
    def _manifest(self) -> str:
        return f"{self.folder}/manifest"

    def _note(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, "part string, schema string").coalesce(1).write.mode("append").parquet(self._manifest)

    def finished(self) -> dict[str, str]:
        """Names of the whole parts with their schemas: as many as the job has parts."""
        self._note([])  # the folder exists from here on
        rows = self.spark.read.schema("part string, schema string").parquet(self._manifest).collect()
        return {r["part"]: r["schema"] for r in rows}

    def once(self, name: str, done: dict[str, str], write: Callable[[], None], schema: str = "") -> None:
        """Run ``write``, which may be repeated without harm, unless an earlier run has ended it."""
        if name not in done:
            write()
            self._note([(name, schema)])
            done[name] = schema

    def table(self, name: str, done: dict[str, str], build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The table that ``build`` gives, from the folder; built only where no earlier run has."""
        path = f"{self.folder}/{name}"
        if name not in done:
            df = build()
            writer = df.write.mode("overwrite")
            self.once(name, done, lambda: (writer.partitionBy(by) if by else writer).parquet(path), df.schema.json())
        return self.spark.read.schema(StructType.fromJson(json.loads(done[name]))).parquet(path)


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """Rows and the sum of their hashes: equal for equal rows in any order and any files."""
    total = F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns]).cast("decimal(38,0)"))
    rows, value = df.agg(F.count("*"), total).first()
    return rows, str(value)


def job_key(conf: InitConfig, tables: dict[str, DataFrame], options: dict, buckets: int) -> str:
    what = [dataclasses.asdict(conf), {k: fingerprint(t) for k, t in sorted(tables.items())}, options, buckets]
    return hashlib.sha256(json.dumps(what, default=str, sort_keys=True).encode()).hexdigest()[:32]


def _in_bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def forecast_init(
    spark: SparkSession,
    conf_text: str,
    out: str,
    work: str,
    y: str,
    x: str | None = None,
    lag: str | None = None,
    fmt: str = "csv",
    buckets: int = BUCKETS,
    options: dict | None = None,
) -> dict[str, str]:
    """Paths of the written outputs by name, from the paths of the input tables and the JSON of the parameters.

    Parameters, the presence of tables and every value of theirs are checked first. ``fmt`` is the format of ``forecast``, ``evaluate``
    and ``errors``; the log is Parquet with a folder per origin, as the production job reads it.
    Rows without an id belong to no series and take no part.
    """
    conf = parse_config("forecast-init", conf_text)
    paths = {k: p for k, p in (("y", y), ("x", x), ("lag", lag)) if p is not None}
    check_files("forecast-init", paths)
    tables = {role: io.read_checked(spark, p, role) for role, p in paths.items()}
    freq, options = conf.forecast_frequency, options or {}
    origins = tuple(cal.rolling_origins(conf.test_start, conf.test_end, freq))
    parts = Parts(spark, f"{work.rstrip('/')}/{job_key(conf, tables, options, buckets)}")
    done = parts.finished()

    summed_to = registry.input_freq(conf.test_model, freq)
    summed = parts.table(
        "panel", done,
        lambda: panel.compact(tables["y"].filter(F.col("id").isNotNull()), origins, summed_to, later=True).withColumn("bucket", _in_bucket("id", buckets)), by="bucket",
    )
    external = {role: parts.table(role, done, lambda role=role: tables[role]) for role in ("x", "lag") if role in tables}

    def request(own: DataFrame, at, bucket: int | None = None) -> registry.Request:
        given = dict(external)
        if given and bucket is not None:  # the lags of these series, and the external series they name
            given["lag"] = given["lag"].filter(_in_bucket("id_y", buckets) == bucket)
            given["x"] = given["x"].join(given["lag"].select(F.col("id_x").alias("id")).distinct(), "id", "left_semi")
        return registry.Request(own.drop("bucket"), at, freq, conf.forecast_period, conf.period_start, given.get("x"), given.get("lag"), options)

    logs = []
    for family, known in registry.FAMILIES.items():
        names = [n for n in dict.fromkeys(conf.test_model) if n in known]
        if not names:
            continue
        if family is registry.pooled_models:  # trained over all series, so its parts are origins
            todo = {f"log_{family.__name__}_{o}": (summed, (o,), None) for o in origins}
        else:
            todo = {f"log_{family.__name__}_{b}": (summed.filter(F.col("bucket") == b), origins, b) for b in range(buckets)}
        for name, work_unit in todo.items():
            logs.append(parts.table(name, done, lambda u=work_unit: registry.forecast(request(*u), names)))
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)

    results = {name: f"{out.rstrip('/')}/{name}" for name in OUTPUTS}
    parts.once("out_forecastlog", done, lambda: io.write_parts(log, results["forecastlog"]))
    if all(f"out_{n}" in done for n in OUTPUTS):
        return results
    written = spark.read.schema(log.schema).parquet(results["forecastlog"]).select(*registry.LOG_COLUMNS)
    actual = panel.actuals(summed.drop("bucket"), freq)
    ranked = lambda: accuracy.rank_models(written, actual, freq, conf.test_back, conf.error_ensemble, conf.error_display)
    combined = parts.table("ensemble", done, lambda: accuracy.ensemble_log(
        written, ranked(), top_model=conf.top_model, fcst_ens=conf.forecast_ensemble, error_ens=conf.error_ensemble,
    ))
    last = {
        "forecast": lambda: combined,
        "evaluate": lambda: accuracy.evaluate(written, combined, actual, conf.top_model),
        "errors": lambda: registry.errors(request(summed, origins), conf.test_model, written),
    }
    for name, build in last.items():
        parts.once(f"out_{name}", done, lambda b=build, n=name: io.write_output(b(), results[n], fmt))
    return results
