import numpy as np
import pytest
from calendar_helpers import day, month
from pyspark.sql import functions as F

from tideloom.operators import features, growth, panel


def by_date(df, *cols):
    return [tuple(r) for r in df.orderBy("id", "ds").select(*cols).collect()]


def test_growth_replaces_infinite_and_missing(panel_of):
    y = panel_of({"a": [0, 0, 0, 2] + [5] * 8 + [3, -3, 0, 3]})
    got = [r[0] for r in by_date(growth.to_growth(y, "m"), "gr")]
    assert got[:12] == [None] * 12
    assert got[12:] == [1.0, -1.0, 1.0, 0.5]


def test_growth_is_by_calendar_not_by_row(panel_of):
    y = panel_of({"a": list(range(1, 27))}).filter(F.col("ds") != F.lit(month(2)))
    got = dict(by_date(growth.to_growth(y, "m"), "ds", "gr"))
    assert got[month(14)] == 1.0  # its base month is missing
    assert got[month(15)] == pytest.approx((16 - 4) / 4)


def test_pct_change_is_by_row(panel_of):
    x = panel_of({"a": list(range(1, 27))}, value="x").filter(F.col("ds") != F.lit(month(2)))
    got = dict(by_date(growth.pct_change(x, "m"), "ds", "x"))
    assert len(got) == 13
    assert got[month(14)] == pytest.approx((15 - 2) / 2)


@pytest.mark.parametrize("h", [6, 12, 30])
def test_growth_round_trip_beyond_a_year(panel_of, h):
    vals = list(np.random.default_rng(1).uniform(5, 9, 60))
    g = growth.to_growth(panel_of({"a": vals}), "m").cache()
    fc = g.filter(F.col("ds") >= F.lit(month(60 - h))).select("id", "ds", F.col("gr").alias("g"))
    act = g.filter(F.col("ds") < F.lit(month(60 - h))).select("id", "ds", "y")
    back = [r[0] for r in by_date(growth.from_growth(fc, act, h, "m"), "y")]
    assert back == pytest.approx(vals[-h:])


def test_growth_without_anchor_is_null_and_ends(spark):
    fc = spark.createDataFrame([("a", day("2020-02-28"), 1.0), ("a", day("2020-02-29"), 1.0)], "id string, ds date, g double")
    act = spark.createDataFrame([("a", day("2019-02-28"), 5.0)], "id string, ds date, y double")
    assert by_date(growth.from_growth(fc, act, 2, "d"), "y") == [(10.0,), (None,)]


def brute_decompose(y):
    n = len(y)
    trend = np.full(n, np.nan)
    for t in range(2, n - 2):
        trend[t] = (y[t - 2] / 2 + y[t - 1] + y[t] + y[t + 1] + y[t + 2] / 2) / 4
    dev = np.array([np.nanmean((y - trend)[k::4]) for k in range(4)])
    seasonal = np.resize(dev - dev.mean(), n)
    return trend, seasonal, y - trend - seasonal


def test_decompose_against_brute_force_and_without_leak(panel_of):
    y = np.random.default_rng(2).uniform(0, 10, 30)
    trend, seasonal, resid = brute_decompose(y)
    got = by_date(features.decompose(panel_of({"a": y})), "dec_trend", "dec_seasonal", "dec_residual")
    for t in range(5, 30):
        assert got[t] == pytest.approx((trend[t - 3], seasonal[t], resid[t - 3]))
    other = y.copy()
    other[20] += 100
    moved = by_date(features.decompose(panel_of({"a": other})), "dec_trend")
    assert moved[20][0] == pytest.approx(got[20][0])  # the value itself is not in its feature
    leaky = by_date(features.decompose(panel_of({"a": other}), lag=2), "dec_trend")
    assert leaky[20][0] == pytest.approx(trend[18] + 100 / 8)


def test_one_hot_has_a_fixed_domain(panel_of):
    f = features.one_hot(features.date_parts(panel_of({"a": [1, 2]})), "month")
    assert [c for c in f.columns if c.startswith("month_")] == [f"month_{k}" for k in range(1, 13)]
    assert f.agg(F.sum("month_1"), F.sum("month_2"), F.sum("month_3")).first() == (1, 1, 0)


def test_momentum_replacement_starts_at_row_13_for_every_frequency(spark, panel_of):
    y = panel_of({"a": [0.0] * 16})
    q = y.withColumn("ds", F.add_months(F.lit(month(0)), 3 * (F.month("ds") - 1 + 12 * (F.year("ds") - 2000)).cast("int")))
    got = [r[0] for r in by_date(features.last_values(q, "q"), "last_momentum")]
    assert got == [None] * 12 + [1.0] * 4


def test_external_series_shifted_forward(spark, panel_of):
    y = panel_of({"a": [1] * 6})
    x = panel_of({"x1": [10, 20, 30]}, value="x")
    lag = spark.createDataFrame([("a", "x1", 2)], "id_y string, id_x string, lag int")
    got = by_date(features.join_x_lagged(y, x, lag, "m"), "x")
    assert [r[0] for r in got] == [None, None, 10.0, 20.0, 30.0, None]
    rnn = by_date(features.join_x_rnn(y, x, lag, month(6), "m"), "xrnn")  # last x at 2, origin at 6
    assert [r[0] for r in rnn] == [None, None, None, None, 10.0, 20.0]
    near = by_date(features.join_x_rnn(y, x, lag, month(3), "m"), "xrnn")  # at least 3
    assert [r[0] for r in near] == [None, None, None, 10.0, 20.0, 30.0]


def test_scaling_uses_training_rows_only(panel_of):
    y = panel_of({"a": [1, 3, 100], "c": [2, 2, 5]})
    train = F.col("ds") < F.lit(month(2))
    z = by_date(features.standardize(y, ["y"], is_train=train), "y")
    assert [r[0] for r in z] == [-1.0, 1.0, 98.0, 0.0, 0.0, 3.0]
    m = features.minmax_scale(y, ["y"], is_train=train)
    assert [r[0] for r in by_date(m, "y")] == [0.0, 1.0, 49.5, 0.0, 0.0, 3.0]
    assert [r[0] for r in by_date(features.minmax_inverse(m, "y"), "y")] == [1, 3, 100, 2, 2, 5]


def test_sequence_windows_split(panel_of):
    w = features.sequence_windows(panel_of({"a": range(10), "short": range(4)}), ["y"], 2, 1, n_val=3)
    got = sorted((r.part, [v[0] for v in r.inputs], r.target) for r in w.collect())
    train = [("train", [float(i), i + 1.0], [i + 2.0]) for i in range(5)]
    val = [("val", [float(i), i + 1.0], [i + 2.0]) for i in range(5, 8)]
    assert got == train + val


def test_feature_sets():
    assert features.feature_set("m", True, True) == ("month_", "quarter_", "lastgr_", "dec_", "x_")
    assert features.feature_set("y", True) == ("lastgr_period", "dec_")


def test_extend_adds_rows_outside_the_range_only(panel_of):
    act, fc = panel_of({"a": [1, 2, 3]}), panel_of({"a": [9, 9, 9, 4, 9]}, start=0).filter(F.col("ds") != F.lit(month(3)))
    assert by_date(features.extend(act, fc, "m"), "y") == [(1.0,), (2.0,), (3.0,), (0.0,), (9.0,)]
    assert panel.series_start(act).first()[1] == month(0)
