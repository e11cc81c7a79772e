import json

import pytest
from calendar_helpers import day, month

from tideloom.plans import jobs
from tideloom.sources import config, io, roles

INIT = {
    "test_start": "2004-01-01", "test_end": "2004-06-01", "test_model": ["naive01", "sma01", "snaive01", "ema02"],
    "forecast_period": 3, "forecast_frequency": "m", "period_start": 0, "top_model": 2, "test_back": 4,
    "forecast_ensemble": "mean", "error_ensemble": "mean", "error_display": "mape",
}


def test_csv_is_read_by_column_name(spark, tmp_path):
    (tmp_path / "y.csv").write_text("extra,y,ds,id\nq,1.5,2020-01-02,007\nq,,2020-01-03,8\n")
    got = io.read_y(spark, str(tmp_path / "y.csv"))
    assert got.dtypes == [("id", "string"), ("ds", "date"), ("y", "double")]
    assert [tuple(r) for r in got.collect()] == [("007", day("2020-01-02"), 1.5), ("8", day("2020-01-03"), None)]
    (tmp_path / "lag.csv").write_text("id_y,id_x,lag\n1,2,3.0\n")
    assert tuple(io.read_lag(spark, str(tmp_path / "lag.csv")).first()) == ("1", "2", 3)


def test_bad_date_is_an_error(spark, tmp_path):
    (tmp_path / "y.csv").write_text("id,ds,y\na,02/01/2020,1\n")
    with pytest.raises(Exception, match="02/01/2020"):
        io.read_y(spark, str(tmp_path / "y.csv")).collect()


def test_nan_becomes_null(spark, tmp_path):
    spark.sql("SELECT 'a' AS id, date'2020-01-01' AS ds, double('NaN') AS y").write.parquet(str(tmp_path / "y.parquet"))
    assert io.read_y(spark, str(tmp_path / "y.parquet")).first().y is None


def test_check_schema_counts_bad_values(spark):
    df = spark.createDataFrame([("a", "2020-01-01", "1"), ("b", "2020-13-01", "x"), ("c", None, None)], "id string, ds string, y string")
    got = {r["column"]: (r.present, r.bad) for r in roles.check_schema(df, "y").collect()}
    assert got == {"id": (True, 0), "ds": (True, 1), "y": (True, 1)}
    assert not roles.schema_ok(df, "y") and not roles.schema_ok(df.drop("ds"), "y")
    assert roles.schema_ok(df.filter("id = 'a'"), "y")
    lag = spark.createDataFrame([("a", "b", "2.0"), ("a", "c", "2.5")], "id_y string, id_x string, lag string")
    assert {r["column"]: r.bad for r in roles.check_schema(lag, "lag").collect()}["lag"] == 1


def test_check_files():
    roles.check_files("forecast-init", ["y"])
    roles.check_files("forecast-init", ["y", "x", "lag"])
    for job, given in (("forecast-init", ["y", "x"]), ("forecast-prod", ["y"]), ("feat-selection", ["y"])):
        with pytest.raises(ValueError):
            roles.check_files(job, given)


def test_config_is_typed_and_names_every_bad_key():
    conf = config.parse_config("forecast-init", json.dumps(INIT))
    assert conf.test_start == day("2004-01-01") and conf.top_model == 2
    with pytest.raises(config.ConfigError) as e:
        config.parse_config("forecast-init", json.dumps({**INIT, "top_model": True, "error_display": "rmse", "test_model": ["nosuch"]}))
    assert set(e.value.keys) == {"top_model", "error_display", "test_model"}
    with pytest.raises(config.ConfigError) as e:
        config.parse_config("forecast-prod", json.dumps({"forecast_start": "1.1.2020"}))
    assert "forecast_start" in e.value.keys and "forecast_period" in e.value.keys
    with pytest.raises(config.ConfigError, match="JSON"):
        config.parse_config("feat-selection", "{")


@pytest.fixture(scope="module")
def panels(panel_of):
    y = panel_of({"a": [100 + (7 * i) % 12 for i in range(54)], "b": [50 + i for i in range(54)], "late": [None] * 51 + [3, 4, 5]})
    return y.filter("y is not null")


def test_init_then_prod(panels, spark, tmp_path):
    init = jobs.forecast_init(panels, config.parse_config("forecast-init", json.dumps(INIT)))
    log = init.forecastlog.cache()
    assert log.count() == 2 * 6 * 4 * 3 + 3 * 2 * 3  # "late" starts in April: May and June, three models
    ev = init.evaluate.cache()
    assert {r.y_type for r in ev.select("y_type").distinct().collect()} == {"forecast", "actual"}
    assert {r.model for r in ev.select("model").distinct().collect()} == {"naive01", "sma01", "snaive01", "ema02", "top2", None}
    assert ev.filter("y_type = 'actual'").count() == 54 * 2 + 3

    # a log that also names a model of another engine
    other = log.limit(1).selectExpr("id", "ds", "dsr", "period", "'lstm01' AS model", "forecast", "time")
    prod_conf = config.ProdConfig(forecast_start=month(54), forecast_period=3, top_model=2, test_back=4)
    prod = jobs.forecast_prod(panels, log.unionByName(other), prod_conf)
    assert prod.skipped == ("lstm01",)
    fc = {(r.id, r.period): r for r in prod.forecast.collect()}
    # "late" has a ranked model at short horizons only; an unranked period is dropped
    assert set(fc) == {(i, p) for i in ("a", "b") for p in range(3)} | {("late", 0), ("late", 1)}
    assert fc[("a", 0)].top_model[0] == "snaive01"  # a repeats itself every 12 months
    assert fc[("b", 0)].top_model == ["naive01", "sma01"]
    assert prod.forecastlog.count() == log.count() + 1 + 2 * 4 * 3 + 3 * 3

    io.write_output(prod.forecast, str(tmp_path / "out"), "csv")
    text = spark.read.option("header", True).csv(str(tmp_path / "out")).filter("id = 'b' and period = 0").first()
    assert json.loads(text.top_model) == ["naive01", "sma01"]


def test_prod_without_matching_rank_averages_all_models(panels):
    init = jobs.forecast_init(panels, config.parse_config("forecast-init", json.dumps(INIT)))
    conf = config.ProdConfig(forecast_start=month(56), forecast_period=2, top_model=1)
    fc = jobs.forecast_prod(panels, init.forecastlog, conf).forecast
    assert {tuple(sorted(r.top_model)) for r in fc.filter("id = 'a'").collect()} == {("ema02", "naive01", "sma01", "snaive01")}


def test_feature_selection_feeds_the_lag_role(spark, panel_of):
    import numpy as np

    rng = np.random.default_rng(2)
    x = {f"x{i}": list(rng.uniform(50, 99, 70)) for i in range(4)}
    y = {"a": [1.0] * 3 + [2 * v for v in x["x2"][:-3]]}
    conf = config.SelectConfig(growth=False, min_data_points=40, min_lag=1, max_lag=6, max_features=1)
    lag = jobs.feat_selection(panel_of(y), panel_of(x, value="x"), conf)
    assert [tuple(r) for r in lag.collect()] == [("a", "x2", 3)]
    assert roles.schema_ok(lag, "lag")


def test_parallelism_where_the_session_sets_nothing(spark):
    from tideloom.session import parallelism

    other = spark.newSession()
    other.conf.unset("spark.sql.shuffle.partitions")
    assert parallelism(other) == spark.sparkContext.defaultParallelism


def test_jobs_on_raw_days_and_a_mid_month_origin_equal_the_direct_plans(spark):
    from tideloom.models import registry
    from tideloom.operators import panel

    y = spark.range(900).selectExpr(
        "'a' AS id", "date_add(date'2003-01-05', cast(id AS int)) AS ds", "10D + id % 13 AS y"
    )
    conf = config.InitConfig(
        test_start=day("2004-03-10"), test_end=day("2004-06-30"), test_model=["naive01", "sma02", "prophet01"], forecast_period=2
    )
    job = jobs.forecast_init(y, conf)
    origins = tuple(r.dsr for r in panel.origins_frame(spark, conf.test_start, conf.test_end, "m").orderBy("dsr").collect())
    direct = registry.forecast(registry.Request(y, origins, "m", 2), conf.test_model)
    key = lambda log: {(r.model, r.dsr, r.period, r.ds): r.forecast for r in log.collect()}
    assert key(job.forecastlog) == pytest.approx(key(direct))
    seen = {r.ds: r.y for r in job.evaluate.filter("y_type = 'actual'").collect()}
    assert seen == pytest.approx({r.ds: r.y for r in panel.actuals(y, "m").collect()})
