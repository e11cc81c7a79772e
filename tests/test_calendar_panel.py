import datetime as dt

import pytest
from calendar_helpers import day, month
from pyspark.sql import functions as F

from tideloom.functions import calendar as cal
from tideloom.operators import panel


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_shift_clamps_month_ends(spark):
    df = spark.createDataFrame([(day("2020-01-31"),), (day("2020-02-29"),)], "ds date")
    got = df.select(cal.shift_period(F.col("ds"), 1, "m"), cal.shift_period(F.col("ds"), 1, "y")).collect()
    assert [tuple(r) for r in got] == [
        (day("2020-02-29"), day("2021-01-31")),
        (day("2020-03-29"), day("2021-02-28")),
    ]


@pytest.mark.parametrize("freq", list("dmqy"))
def test_period_index_round_trip(spark, freq):
    df = spark.sql("SELECT explode(sequence(date'1899-11-30', date'2031-01-05', interval 17 day)) AS ds")
    bad = df.filter(
        cal.period_start_date(cal.period_index(F.col("ds"), freq), freq) != cal.bucket(F.col("ds"), freq)
    )
    assert bad.count() == 0
    for d in (day("1999-12-31"), day("2000-02-29")):
        assert cal.date_of(cal.index_of(d, freq), freq) == cal.bucket_of(d, freq)


def test_origins_of_a_mid_month_start_skip_their_month_and_overshoot():
    got = cal.rolling_origins(day("2000-01-15"), day("2000-04-10"), "m")
    assert got == [day("2000-02-15"), day("2000-03-15"), day("2000-04-15")]
    assert cal.rolling_origins(day("2000-01-03"), day("2000-01-05"), "d") == [
        day("2000-01-05"), day("2000-01-06"), day("2000-01-07"),
    ]
    assert cal.rolling_origins(day("2000-01-01"), day("2000-07-01"), "q") == [
        day("2000-01-01"), day("2000-04-01"), day("2000-07-01"),
    ]


def test_horizon_of_a_mid_period_origin_starts_at_the_next_bucket(spark):
    df = spark.createDataFrame([("a", day("2000-02-15"))], "id string, dsr date")
    got = rows(panel.horizon(df, 2, "m", period_start=1), "ds", "period")
    assert got == [(day("2000-03-01"), 1), (day("2000-04-01"), 2)]


def test_fill_gaps_sums_duplicates_and_fills_zero(spark):
    df = spark.createDataFrame(
        [("a", day("2000-01-01"), 1.0), ("a", day("2000-01-01"), 2.0), ("a", day("2000-01-03"), 4.0), ("a", day("2000-01-04"), None)],
        "id string, ds date, y double",
    )
    assert rows(panel.fill_gaps(df), "ds", "y") == [
        (day("2000-01-01"), 3.0), (day("2000-01-02"), 0.0), (day("2000-01-03"), 4.0), (day("2000-01-04"), 0.0),
    ]
    wide = panel.fill_gaps(df, day("1999-12-31"), day("2000-01-05"))
    assert rows(wide, "ds", "y")[0] == (day("1999-12-31"), 0.0)
    assert rows(wide, "ds", "y")[-1] == (day("2000-01-05"), 0.0)
    assert panel.fill_gaps(df, day("2000-01-05"), day("2000-01-01")).count() == 0


def test_history_extends_ended_series_and_drops_late_ones(panel_of):
    y = panel_of({"ended": [5, 6], "late": [None] * 6 + [7]}).filter("y is not null")
    got = panel.history(y, [month(4), month(8)], "m")
    assert rows(got, "id", "dsr", "hist") == [
        ("ended", month(4), [5.0, 6.0, 0.0, 0.0]),
        ("ended", month(8), [5.0, 6.0] + [0.0] * 6),
        ("late", month(8), [7.0, 0.0]),
    ]


def test_history_of_a_mid_month_origin_holds_the_partial_bucket(spark):
    df = spark.createDataFrame(
        [("a", day("2000-01-10"), 1.0), ("a", day("2000-02-03"), 2.0), ("a", day("2000-02-20"), 4.0), ("a", day("2000-03-20"), 8.0)],
        "id string, ds date, y double",
    )
    got = panel.history(df, [day("2000-02-15"), day("2000-03-01"), day("2000-03-15")], "m")
    assert rows(got, "dsr", "hist") == [
        (day("2000-02-15"), [1.0, 2.0]),
        (day("2000-03-01"), [1.0, 6.0]),
        (day("2000-03-15"), [1.0, 6.0, 0.0]),
    ]
    small = panel.compact(df, [day("2000-02-15"), day("2000-03-01"), day("2000-03-15")], "m")
    again = panel.history(small, [day("2000-02-15"), day("2000-03-01"), day("2000-03-15")], "m")
    assert rows(again, "dsr", "hist", "b0", "s0") == rows(got, "dsr", "hist", "b0", "s0")


def test_history_does_not_see_the_future(panel_of):
    a = panel_of({"a": range(1, 25)})
    b = a.withColumn("y", F.when(F.col("ds") >= F.lit(month(12)), 999.0).otherwise(F.col("y")))
    o = [month(6), month(12)]
    assert rows(panel.history(a, o, "m"), "dsr", "hist") == rows(panel.history(b, o, "m"), "dsr", "hist")


def test_work_units_and_clamp(panel_of):
    y = panel_of({"a": [-1, 2], "b": [3, 4]})
    assert panel.work_units(y, [month(1), month(2)], ["m1", "m2", "m3"]).count() == 12
    assert rows(panel.clamp_zero(y), "y")[0] == (0.0,)
    assert isinstance(month(3), dt.date)
