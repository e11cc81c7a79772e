import json

import pytest
from calendar_helpers import month

from tideloom.models import registry
from tideloom.plans import jobs, restart
from tideloom.sources import config, io

CONF = {
    "test_start": "2004-01-01", "test_end": "2004-04-01", "test_model": ["naive01", "linearx01", "prophet01", "randomforest01"],
    "forecast_period": 2, "forecast_frequency": "m", "period_start": 0, "top_model": 2, "test_back": 3,
    "forecast_ensemble": "mean", "error_ensemble": "mean", "error_display": "mape",
}
OPTIONS = {"trees": 2, "rounds": 2, "depth": 2}


@pytest.fixture()
def inputs(panel_of, tmp_path):
    wave = lambda k: [60 + 7 * k + (i * (k + 3)) % 11 + i % 12 for i in range(56)]
    y = panel_of({f"s{k}": wave(k) for k in range(5)} | {"short": [3.0, 4.0]})
    x = panel_of({"p": wave(8), "q": wave(9)}, value="x")
    lag = y.sparkSession.createDataFrame([("s0", "p", 1), ("s1", "p", 2), ("s1", "q", 0), ("s4", "q", 3)], "id_y string, id_x string, lag int")
    paths = {n: str(tmp_path / f"{n}.parquet") for n in ("y", "x", "lag")}
    for n, t in (("y", y), ("x", x), ("lag", lag)):
        t.write.parquet(paths[n])
    return paths


def rows(spark, path, fmt="parquet"):
    df = spark.read.format(fmt).load(path)
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_a_lost_run_is_continued_to_the_same_rows(spark, tmp_path, inputs, monkeypatch):
    run = lambda name: restart.forecast_init(spark, json.dumps(CONF), str(tmp_path / f"out_{name}"), str(tmp_path / f"work_{name}"), **inputs, fmt="parquet", buckets=2, options=OPTIONS)
    whole = run("whole")
    real, calls, lost_at = registry.forecast, [], 4

    def forecast(req, names):
        calls.append(names)
        if len(calls) == lost_at:
            raise RuntimeError("lost")
        return real(req, names)

    monkeypatch.setattr(registry, "forecast", forecast)
    with pytest.raises(RuntimeError):
        run("lost")
    assert not (tmp_path / "out_lost").exists()
    monkeypatch.setattr(accuracy := restart.accuracy, "evaluate", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):  # lost again, among the outputs
        run("lost")
    parts = 2 + 2 + 4  # two families by two buckets, pooled trees by four origins
    assert len(calls) == parts + 1  # only the part that was under way is repeated
    monkeypatch.undo()
    monkeypatch.setattr(registry, "forecast", None)  # no part is built any more
    again = run("lost")
    for name in restart.OUTPUTS:
        assert rows(spark, again[name]) == rows(spark, whole[name]), name
    assert accuracy.evaluate
    monkeypatch.setattr(io, "write_output", None)
    assert run("lost") == again  # nothing is left to do


def test_equal_to_the_job_in_one_go_and_blind_to_other_inputs(spark, tmp_path, inputs):
    conf = {**CONF, "test_model": ["naive01", "sma02", "linearx01"]}
    run = lambda out: restart.forecast_init(spark, json.dumps(conf), str(tmp_path / out), str(tmp_path / "work"), **inputs, buckets=3)
    got = run("first")
    y, x, lag = (io.read_role(spark, inputs[n], n) for n in ("y", "x", "lag"))
    want = jobs.forecast_init(y, config.parse_config("forecast-init", json.dumps(conf)), x, lag)
    key = lambda log: {(r.id, r.model, r.dsr, r.ds, r.period): r.forecast for r in log.collect()}
    assert key(spark.read.parquet(got["forecastlog"])) == pytest.approx(key(want.forecastlog))
    told = spark.read.option("header", True).csv(got["errors"])
    assert {(r.id, r.model, r.dsr, r.text) for r in told.collect()} == {(r.id, r.model, str(r.dsr), r.text) for r in want.errors.collect()}
    assert spark.read.option("header", True).csv(got["evaluate"]).count() == want.evaluate.count()
    spark.createDataFrame([("new", month(50), 5.0), (None, month(50), 5.0)], y.schema).write.mode("append").parquet(inputs["y"])
    ids = {r.id for r in spark.read.parquet(run("second")["forecastlog"]).select("id").distinct().collect()}
    assert "new" in ids and None not in ids
    assert len([p for p in (tmp_path / "work").iterdir() if p.is_dir()]) == 2


def test_bad_values_end_the_job_before_it_starts(spark, tmp_path):
    (tmp_path / "y.csv").write_text("id,ds,y\na,2020-01-02,1.5\na,02.01.2020,q\n")
    with pytest.raises(io.SchemaError, match="ds: 1 values aren't date; y: 1 values aren't double"):
        restart.forecast_init(spark, json.dumps(CONF), str(tmp_path / "out"), str(tmp_path / "work"), y=str(tmp_path / "y.csv"))
    (tmp_path / "z.csv").write_text("id,y\na,1.5\n")
    with pytest.raises(io.SchemaError, match="ds: missing"):
        io.read_checked(spark, str(tmp_path / "z.csv"), "y")
    with pytest.raises(ValueError, match="together"):
        restart.forecast_init(spark, json.dumps(CONF), str(tmp_path / "out"), str(tmp_path / "work"), y=str(tmp_path / "y.csv"), x="x.csv")
    assert not (tmp_path / "work").exists()
