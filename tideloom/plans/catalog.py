"""One query per operator over the star-schema tables.

Panels come from :mod:`tideloom.sources.panels`. Amounts are rounded to 4 digits and ratios
to 6 in the results, so that two engines agree in spite of the order of additions.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..models import registry
from ..operators import accuracy, features, growth, panel, selection
from ..session import cut_lineage, shared_folder
from ..sources import config, io, panels, roles
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

INIT = dict(
    test_start=dt.date(2000, 1, 1), test_end=dt.date(2000, 12, 1), forecast_period=4,
    test_model=list(registry.NATIVE),
)
MID = (dt.date(2000, 1, 15), dt.date(2000, 4, 10))
PROD_START = dt.date(2001, 1, 1)
CUT = dt.date(2000, 1, 1)
H = 4


def query(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


# -- shared inputs ----------------------------------------------------------------------

y_m = panels.segment_sales
x_m = panels.brand_quantity
y_cust = panels.customer_sales


def y_d(spark, d):
    return panels.segment_sales(spark, d, "d")


def lag_map(spark, d) -> DataFrame:
    """A few external series per target, paired by a rule on their names."""
    no = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    y = panels.table(spark, d, "customer").select(F.col("c_mktsegment").alias("id_y")).distinct()
    x = panels.table(spark, d, "part").select(F.col("p_brand").alias("id_x"), no.alias("no")).distinct()
    y = y.withColumn("k", F.pmod(-F.length("id_y"), F.lit(8)))
    x = x.withColumn("k", F.pmod("no", F.lit(8)))
    return y.join(x, "k").select(
        "id_y", "id_x", (F.pmod("no", F.lit(6)) + 1).cast("int").alias("lag")
    )


def origins() -> tuple[dt.date, ...]:
    return tuple(cal.rolling_origins(INIT["test_start"], INIT["test_end"], "m"))


def request(spark, d, **kw) -> registry.Request:
    return registry.Request(**{"y": y_m(spark, d), "origins": origins(), "freq": "m", "h": H, **kw})


def log_of(names) -> Query:
    def run(spark, d):
        return tidy(registry.forecast(request(spark, d), names)).drop("time")

    return run


def native_log(spark, d) -> DataFrame:
    return registry.forecast(request(spark, d), registry.NATIVE)


def stored(spark, d) -> tuple[DataFrame, DataFrame]:
    """The log of the native models and the actuals, written once for queries that read them several times."""
    return cut_lineage(native_log(spark, d)), cut_lineage(panel.actuals(y_m(spark, d), "m"))


def ranks(spark, d, log=None, actual=None, **kw) -> DataFrame:
    log = native_log(spark, d) if log is None else log
    actual = panel.actuals(y_m(spark, d), "m") if actual is None else actual
    return accuracy.rank_models(log, actual, "m", **kw)


MONEY = ("y", "x", "forecast", "actual", "mae", "v", "xrnn")


def tidy(df: DataFrame, **digits: int) -> DataFrame:
    """Round DOUBLE columns: money to 4 digits, everything else to 6."""
    return df.select(
        *[
            F.round(n, digits.get(n, 4 if n in MONEY else 6)).alias(n) if t == "double" else n
            for n, t in df.dtypes
        ]
    )


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/tideloom-{name}-{uuid.uuid4().hex}"


# -- A: sources, sinks, validation --------------------------------------------------------


def _csv_round_trip(name, frame, reader) -> Query:
    def run(spark, d):
        path = scratch(spark, name)
        io.write_output(frame(spark, d), path, "csv")
        return tidy(reader(spark, path))

    return run


QUERIES["a1_read_y"] = _csv_round_trip("y", y_m, io.read_y)
QUERIES["a2_read_x"] = _csv_round_trip("x", x_m, io.read_x)
QUERIES["a3_read_lag"] = _csv_round_trip("lag", lag_map, io.read_lag)
QUERIES["a4_read_forecastlog"] = _csv_round_trip(
    "log", lambda s, d: registry.forecast(request(s, d), ["naive01"]), io.read_forecastlog
)


@query("a5_check_schema")
def _(spark, d):
    o = panels.table(spark, d, "orders")
    raw = o.select(
        F.col("o_custkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ds"),
        F.col("o_orderpriority").alias("y"),
    )
    return roles.check_schema(raw, "y")


@query("a9_write_parts")
def _(spark, d):
    path = scratch(spark, "parts")
    io.write_parts(registry.forecast(request(spark, d), ["naive01", "sma01"]), path)
    back = spark.read.parquet(path)
    return back.groupBy("dsr", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("forecast"), 2).alias("total")
    )


@query("a10_write_output")
def _(spark, d):
    path = scratch(spark, "out")
    log = native_log(spark, d)
    ens = accuracy.ensemble_log(log, ranks(spark, d, log)).select("id", "dsr", "ds", "top_model")
    io.write_output(ens, path, "csv")
    return spark.read.option("header", True).csv(path).select(
        "id", F.to_date("dsr").alias("dsr"), F.to_date("ds").alias("ds"), "top_model"
    )


@query("a11_union_log")
def _(spark, d):
    new = registry.forecast(request(spark, d, origins=(dt.date(2000, 7, 1),)), ["sma01"])
    old = registry.forecast(request(spark, d), ["naive01"])
    return tidy(io.union_log(new, old, dt.date(2000, 7, 1))).drop("time")


# -- B: calendar and panel ------------------------------------------------------------------


@query("b1_bucket")
def _(spark, d):
    ds = F.col("o_orderdate").cast("date")
    return (
        panels.table(spark, d, "orders").select(ds.alias("ds")).distinct()
        .select("ds", *[cal.bucket(F.col("ds"), f).alias(f"b_{f}") for f in cal.FREQS])
    )


@query("b2_series_start")
def _(spark, d):
    return panel.series_start(y_cust(spark, d))


@query("b3_clip_history")
def _(spark, d):
    return tidy(panel.clip_history(y_cust(spark, d), origins()))


@query("b4_fill_gaps")
def _(spark, d):
    return tidy(panel.fill_gaps(y_d(spark, d)))


@query("b5_resample")
def _(spark, d):
    return tidy(panel.resample(y_cust(spark, d), "m"))


@query("b5_resample_quarter")
def _(spark, d):
    return tidy(panel.resample(y_d(spark, d), "q"))


@query("b5_history")
def _(spark, d):
    h = panel.history(y_cust(spark, d), origins(), "m")
    return tidy(
        h.select("id", "dsr", "b0", F.posexplode("hist").alias("pos", "y")).select(
            "id", "dsr", cal.period_start_date(F.col("b0") + F.col("pos"), "m").alias("ds"), "y"
        )
    )


@query("b5_history_mid_month")
def _(spark, d):
    h = panel.history(y_d(spark, d), cal.rolling_origins(*MID, "m"), "m")
    return tidy(
        h.select("id", "dsr", "b0", F.posexplode("hist").alias("pos", "y")).select(
            "id", "dsr", cal.period_start_date(F.col("b0") + F.col("pos"), "m").alias("ds"), "y"
        )
    )


@query("b6_actuals")
def _(spark, d):
    return tidy(panel.actuals(y_d(spark, d), "m"))


@query("b7_resample_x")
def _(spark, d):
    return tidy(panel.resample_x(x_m(spark, d), CUT, "q"))


@query("b8_shift_period")
def _(spark, d):
    ds = F.col("o_orderdate").cast("date")
    days = panels.table(spark, d, "orders").select(ds.alias("ds")).distinct()
    ahead = {f"p_{f}": cal.shift_period(F.col("ds"), 1, f) for f in cal.FREQS}
    back = {f"m_{f}": cal.shift_period(F.col("ds"), -2, f) for f in cal.FREQS}
    return days.withColumns({**ahead, **back})


@query("b9_horizon")
def _(spark, d):
    units = panel.work_units(y_m(spark, d), cal.rolling_origins(*MID, "m"), ["naive01"])
    return panel.horizon(units.drop("model"), H, "m", period_start=1)


@query("b10_origins")
def _(spark, d):
    days = panel.dates_array(cal.rolling_origins(*MID, "m"))
    return panel.series_start(y_d(spark, d)).withColumn("dsr", F.explode(days)).filter("act_st < dsr")


@query("b11_clamp_zero")
def _(spark, d):
    return tidy(panel.clamp_zero(y_m(spark, d).withColumn("y", F.col("y") - 9_000_000.0)))


@query("b12_work_units")
def _(spark, d):
    return panel.work_units(y_m(spark, d), origins(), ["naive01", "sma01", "ema03"])


# -- C: growth ------------------------------------------------------------------------------


@query("c1_to_growth")
def _(spark, d):
    return tidy(growth.to_growth(panel.resample(y_cust(spark, d), "m"), "m"))


@query("c1_to_growth_daily")
def _(spark, d):
    return tidy(growth.to_growth(panel.fill_gaps(y_d(spark, d)), "d"))


@query("c2_from_growth")
def _(spark, d):
    g = growth.to_growth(panel.resample(y_m(spark, d), "m"), "m")
    fc = g.filter(F.col("ds") >= F.lit(CUT)).select("id", "ds", F.round("gr", 6).alias("g"))
    act = g.filter(F.col("ds") < F.lit(CUT)).select("id", "ds", "y")
    return tidy(growth.from_growth(fc, act, 24, "m"), g=6)


@query("c3_pct_change")
def _(spark, d):
    return tidy(growth.pct_change(x_m(spark, d), "m"), x=6)


# -- D: features ----------------------------------------------------------------------------


def panel_m(spark, d):
    return panel.resample(y_m(spark, d), "m")


@query("d0_extend")
def _(spark, d):
    act = panel_m(spark, d).filter(F.col("ds") < F.lit(CUT))
    fc = registry.forecast(request(spark, d, origins=(CUT,)), ["sma01"])
    return tidy(features.extend(act, fc.select("id", "ds", F.col("forecast").alias("y")), "m"))


@query("d1_date_parts")
def _(spark, d):
    return tidy(features.date_parts(panel.fill_gaps(y_d(spark, d))))


@query("d2_one_hot")
def _(spark, d):
    parts = features.date_parts(panel_m(spark, d)).select("id", "ds", "month", "quarter")
    return features.one_hot(features.one_hot(parts, "month"), "quarter")


@query("d3_last_values")
def _(spark, d):
    f = features.last_values(panel.resample(y_cust(spark, d), "m"), "m")
    return tidy(f.drop("last_momentum"), last_period=4, last_year=4)


@query("d4_last_momentum")
def _(spark, d):
    return tidy(features.last_values(panel_m(spark, d), "m").select("id", "ds", "last_momentum"))


@query("d5_last_growth")
def _(spark, d):
    return tidy(features.last_growth(panel_m(spark, d), "m").drop("y"))


def _decompose(lag):
    def run(spark, d):
        f = features.decompose(panel_m(spark, d), lag)
        return tidy(f, dec_trend=5, dec_seasonal=5, dec_residual=5)

    return run


QUERIES["d6_decompose"] = _decompose(3)
QUERIES["d6_decompose_lag2"] = _decompose(2)


@query("d7_join_x_lagged")
def _(spark, d):
    x = cut_lineage(panel.resample_x(x_m(spark, d), CUT, "m"))
    return tidy(features.join_x_lagged(panel_m(spark, d), x, lag_map(spark, d), "m"))


@query("d8_join_x_rnn")
def _(spark, d):
    x = cut_lineage(panel.resample_x(x_m(spark, d), CUT, "m"))
    return tidy(features.join_x_rnn(panel_m(spark, d), x, lag_map(spark, d), CUT, "m"))


@query("d9_select_features")
def _(spark, d):
    f = features.last_growth(features.last_values(panel_m(spark, d), "m"), "m")
    f = features.decompose(f)
    keep = features.feature_set("y")
    return tidy(
        features.select_features(f, keep, dt.date(1999, 1, 1), dt.date(2000, 12, 1)),
        last_period=4, dec_trend=5, dec_seasonal=5, dec_residual=5,
    )


@query("d10_standardize")
def _(spark, d):
    return tidy(
        features.standardize(panel_m(spark, d), ["y"], is_train=F.col("ds") < F.lit(CUT)), y=6
    )


@query("d11_minmax_scale")
def _(spark, d):
    s = features.minmax_scale(panel_m(spark, d), ["y"], is_train=F.col("ds") < F.lit(CUT))
    back = features.minmax_inverse(s, "y").select("id", "ds", F.col("y").alias("v"))
    return tidy(s.join(back, ["id", "ds"]).drop("y_range"), y=6, y_min=4)


@query("d12_sequence_windows")
def _(spark, d):
    f = features.last_values(panel_m(spark, d), "m").dropna()
    w = features.sequence_windows(f, ["y", "last_year"], look_back=24, forward=4, n_val=12)
    flat = F.flatten("inputs")
    return tidy(
        w.select(
            "id", "ds", "part",
            F.size("inputs").alias("n_in"),
            F.get(F.get("inputs", F.lit(0)), F.lit(1)).alias("first_in"),
            F.element_at(flat, -2).alias("last_in"),
            F.element_at("target", 1).alias("first_out"),
            F.element_at("target", -1).alias("last_out"),
        ),
        first_in=4, last_in=4, first_out=4, last_out=4,
    )


@query("d13_feature_sets")
def _(spark, d):
    # every set applied to one wide frame: how many of its features a row has, and their sum
    f = features.decompose(features.last_growth(features.last_values(panel_m(spark, d), "m"), "m"))
    for part in ("month", "quarter"):
        f = features.one_hot(f.withColumn(part, getattr(F, part)("ds")), part)
    sets = []
    for freq in features.NOMINAL_FEATURES:
        for growth in (False, True):
            values = F.array(*[F.col(c).cast("double") for c in features.select_features(f, features.feature_set(freq, growth)).columns if c not in ("id", "ds", "y")])
            known = F.filter(values, lambda v: v.isNotNull())
            total = F.aggregate(known, F.lit(0.0), lambda acc, v: acc + v)
            sets.append(F.struct(F.lit(freq).alias("freq"), F.lit(growth).alias("growth"), F.size(known).alias("n_values"), total.alias("v")))
    return tidy(f.select("id", "ds", F.inline(F.array(*sets))))


# -- E: models ------------------------------------------------------------------------------

QUERIES["e1_naive01"] = log_of(["naive01"])
QUERIES["e2_snaive01"] = log_of(["snaive01"])
QUERIES["e3_sma"] = log_of(["sma01", "sma02", "sma03"])
QUERIES["e4_wma"] = log_of(["wma01", "wma02", "wma03"])
QUERIES["e5_ema"] = log_of(["ema01", "ema02", "ema03"])
QUERIES["e6_expo01"] = log_of(["expo01"])
QUERIES["e7_expo02"] = log_of(["expo02"])
QUERIES["e8_expo03"] = log_of(["expo03"])


@query("b12_errors")
def _(spark, d):
    # customers with less than a season of history get no seasonal forecast
    req = request(spark, d, y=y_cust(spark, d), origins=(dt.date(1993, 1, 1), CUT))
    names = ("naive01", "snaive01", "sma01")
    return registry.errors(req, names, registry.forecast(req, names))


QUERIES["e9_linear"] = log_of(["linear01", "linear02"])
QUERIES["e15_arima"] = log_of(["arima01", "arima02"])
QUERIES["e17_autoarima"] = log_of(["autoarima01", "autoarima02"])
QUERIES["e19_prophet01"] = log_of(["prophet01"])


def _with_x(names, **kw) -> Query:
    def run(spark, d):
        req = request(spark, d, x=x_m(spark, d), lag=lag_map(spark, d), **kw)
        return tidy(registry.forecast(req, names)).drop("time")

    return run


QUERIES["e10_linearx"] = _with_x(["linearx01", "linearx02"])
QUERIES["e16_arimax"] = _with_x(["arimax01", "arimax02"])
QUERIES["e18_autoarimax"] = _with_x(["autoarimax01", "autoarimax02"])


@query("e15_arima_110")
def _(spark, d):
    # the same solver with one lag: a regression in closed form
    req = request(spark, d, options={"order": (1, 0)})
    return tidy(registry.forecast(req, ["arima01"])).drop("time")


def _finite(log: DataFrame) -> DataFrame:
    """Which forecasts there are, and that they are finite."""
    finite = ~F.isnan("forecast") & (F.abs("forecast") < float("inf"))
    return log.select("id", "ds", "dsr", "period", "model", finite.alias("finite"))


@query("e15_e17_guards")
def _(spark, d):
    # short and sparse series: every one that is long enough has all its forecasts, the others none
    req = request(spark, d, y=y_cust(spark, d), origins=(dt.date(1995, 7, 1), CUT))
    return _finite(registry.forecast(req, ["arima01", "arima02", "autoarima01"]))


@query("e16_e18_guards")
def _(spark, d):
    req = request(spark, d, x=x_m(spark, d), lag=lag_map(spark, d))
    return _finite(registry.forecast(req, ["arimax01", "arimax02", "autoarimax01", "autoarimax02"]))


@query("e19_guards")
def _(spark, d):
    req = request(spark, d, y=panels.event_values(spark, d), origins=(dt.date(2024, 1, 3), dt.date(2024, 2, 1)), h=2)
    return _finite(registry.forecast(req, ["prophet01"]))


# tree ensembles: every origin is a separate fit, so one origin here; all series, small ensembles
ENSEMBLE = {"trees": 10, "rounds": 5, "depth": 4}
QUERIES["e11_randomforest"] = _with_x(["randomforest01", "randomforest02"], options=ENSEMBLE)
QUERIES["e12_randomforestx"] = _with_x(["randomforestx01", "randomforestx02"], options=ENSEMBLE)
QUERIES["e13_xgboost"] = _with_x(["xgboost01", "xgboost02"], options=ENSEMBLE)
QUERIES["e14_xgboostx"] = _with_x(["xgboostx01", "xgboostx02"], options=ENSEMBLE)


@query("e9_linear_customers")
def _(spark, d):
    req = request(spark, d, y=y_cust(spark, d), origins=(CUT,))
    return tidy(registry.forecast(req, ["linear01", "arima01", "expo03"])).drop("time")


@query("e1_e5_customers")
def _(spark, d):
    req = request(spark, d, y=y_cust(spark, d), origins=(CUT, PROD_START))
    return tidy(registry.forecast(req, registry.NATIVE)).drop("time")


@query("e1_e5_daily_short")
def _(spark, d):
    # 30 days of events: the seasonal guard drops snaive01
    req = request(
        spark, d, y=panels.event_values(spark, d), freq="d", h=7,
        origins=(dt.date(2024, 1, 20), dt.date(2024, 1, 31)),
    )
    return tidy(registry.forecast(req, registry.NATIVE)).drop("time")


@query("e1_e5_mid_month")
def _(spark, d):
    req = request(
        spark, d, y=y_d(spark, d), origins=tuple(cal.rolling_origins(*MID, "m")), period_start=1
    )
    return tidy(registry.forecast(req, registry.NATIVE)).drop("time")


# -- F: accuracy ----------------------------------------------------------------------------


@query("f1_f2_errors")
def _(spark, d):
    log = registry.forecast(request(spark, d, y=y_cust(spark, d)), ["naive01", "sma01"])
    return tidy(accuracy.score_log(log, panel.actuals(y_cust(spark, d), "m"))).drop("time")


@query("f3_rank_models")
def _(spark, d):
    return tidy(ranks(spark, d))


@query("f3_rank_models_median")
def _(spark, d):
    return tidy(ranks(spark, d, error_ens="median"))


@query("f4_ensemble")
def _(spark, d):
    new = registry.forecast(request(spark, d, origins=(PROD_START,)), registry.NATIVE)
    return _flat_list(accuracy.ensemble(new, ranks(spark, d)))


@query("f4_ensemble_no_rank")
def _(spark, d):
    new = registry.forecast(request(spark, d, origins=(dt.date(2001, 3, 1),)), registry.NATIVE)
    return _flat_list(accuracy.ensemble(new, ranks(spark, d)))


@query("f5_ensemble_log")
def _(spark, d):
    log, actual = stored(spark, d)
    return _flat_list(accuracy.ensemble_log(log, ranks(spark, d, log, actual)))


@query("f6_evaluate")
def _(spark, d):
    log, actual = stored(spark, d)
    ens = cut_lineage(accuracy.ensemble_log(log, ranks(spark, d, log, actual)))
    return _flat_list(accuracy.evaluate(log, ens, actual))


@query("f7_median_ensemble")
def _(spark, d):
    log, actual = stored(spark, d)
    rank = ranks(spark, d, log, actual, error_ens="median", error_dsp="mae")
    return _flat_list(
        accuracy.ensemble_log(log, rank, fcst_ens="median", error_ens="median"), error=5
    )


def _flat_list(df: DataFrame, **digits) -> DataFrame:
    """Model lists as text, so that any checker can compare them."""
    return tidy(df.withColumn("top_model", F.array_join("top_model", ",")), **digits)


# -- G: feature selection -------------------------------------------------------------------


def prepared(spark, d, written: bool = True):
    """Cleaned targets and external series; written once when a query reads them repeatedly."""
    y = selection.prepare_y(y_m(spark, d), "m")
    x = selection.prepare_x(x_m(spark, d), "m", True, 48)
    return (cut_lineage(y), cut_lineage(x)) if written else (y, x)


@query("g1_clean_after_gap")
def _(spark, d):
    return tidy(selection.clean_after_gap(y_cust(spark, d), "m", "y"))


@query("g2_prepare_x")
def _(spark, d):
    return tidy(prepared(spark, d, False)[1], x=6)


@query("g2_x_report")
def _(spark, d):
    return selection.x_report(x_m(spark, d), prepared(spark, d, False)[1])


@query("g3_prepare_y")
def _(spark, d):
    return tidy(prepared(spark, d, False)[0], y=6)


@query("g4_lag_corr")
def _(spark, d):
    return tidy(selection.lag_corr(*prepared(spark, d)))


@query("g5_best_lag")
def _(spark, d):
    return tidy(selection.best_lag(*prepared(spark, d)))


@query("g6_align_lagged")
def _(spark, d):
    y, x = prepared(spark, d)
    return tidy(selection.align_lagged(y, x, lag_map(spark, d)), y=6, x=6)


@query("g7_score_ols")
def _(spark, d):
    return tidy(selection.score_first(*prepared(spark, d), lag_map(spark, d), "AICc"), score=5)


@query("g8_score_r2adj")
def _(spark, d):
    return tidy(selection.score_first(*prepared(spark, d), lag_map(spark, d), "R2-adj"))


@query("g9_forward_round1")
def _(spark, d):
    y, x = prepared(spark, d)
    return tidy(
        selection.forward_select(y, x, selection.best_lag(y, x), "AICc", max_features=1), score=5
    )


@query("g9_forward_select")
def _(spark, d):
    y, x = prepared(spark, d)
    return tidy(selection.forward_select(y, x, selection.best_lag(y, x), "AICc", max_features=5))


def _by_name(name, most=2):
    def run(spark, d):
        y, x = prepared(spark, d)
        chosen = selection.fit(name, y, x, selection.best_lag(y, x), max_features=most)
        return tidy(chosen, score=6 if name == "r2adj01" else 5)

    return run


QUERIES["g9_forward_round2"] = _by_name("aicc01")
QUERIES["g10_aic01"] = _by_name("aic01")
QUERIES["g10_r2adj01"] = _by_name("r2adj01")
QUERIES["g10_aic01_five"] = _by_name("aic01", 5)
QUERIES["g10_r2adj01_five"] = _by_name("r2adj01", 5)


# -- H: jobs --------------------------------------------------------------------------------


@query("h1_forecast_init")
def _(spark, d):
    r = jobs.forecast_init(y_m(spark, d), config.InitConfig(**INIT))
    return _flat_list(r.evaluate)


@query("h1_forecast_init_x")
def _(spark, d):
    conf = config.InitConfig(**{**INIT, "test_model": ["naive01", "linearx01", "arimax01", "prophet01"]})
    r = jobs.forecast_init(y_m(spark, d), conf, x_m(spark, d), lag_map(spark, d))
    return _flat_list(r.forecast)


@query("h2_forecast_prod")
def _(spark, d):
    conf = config.ProdConfig(forecast_start=PROD_START, forecast_period=H)
    return _flat_list(jobs.forecast_prod(y_m(spark, d), cut_lineage(native_log(spark, d)), conf).forecast)


@query("h2_forecast_prod_log")
def _(spark, d):
    conf = config.ProdConfig(forecast_start=PROD_START, forecast_period=H)
    log = jobs.forecast_prod(y_m(spark, d), cut_lineage(native_log(spark, d)), conf).forecastlog
    return tidy(log).drop("time")


@query("h3_feat_selection")
def _(spark, d):
    conf = config.SelectConfig(min_data_points=48, max_features=2)
    return jobs.feat_selection(y_m(spark, d), x_m(spark, d), conf)


@query("h3_feat_selection_five")
def _(spark, d):
    conf = config.SelectConfig(min_data_points=48, max_features=5)
    return jobs.feat_selection(y_m(spark, d), x_m(spark, d), conf)
