import numpy as np
import pandas as pd
import pytest
from calendar_helpers import month
from pyspark.sql import functions as F

from tideloom.operators import selection, skew


def test_clean_after_gap_keeps_only_the_newest_run(panel_of):
    y = panel_of({"gap": [1, 2, None, 4, 5, None, 7, 8], "full": [1, 2, 3]}).filter("y is not null")
    dup = y.unionByName(y.filter("id = 'full' and y = 3"))
    got = sorted((r.id, r.ds, r.y) for r in selection.clean_after_gap(dup, "m", "y").collect())
    assert got == [
        ("full", month(0), 1.0), ("full", month(1), 2.0), ("full", month(2), 6.0),
        ("gap", month(6), 7.0), ("gap", month(7), 8.0),
    ]


def test_clean_after_gap_of_dates_off_the_bucket_start(spark):
    # the 15th of each month: every bucket start between first and last is missing
    df = spark.createDataFrame([("a", month(i).replace(day=15), 1.0) for i in range(4)], "id string, ds date, y double")
    assert [r.ds for r in selection.clean_after_gap(df, "m", "y").collect()] == [month(3).replace(day=15)]


def brute_corr(y: dict, x: dict, lag: int):
    s = pd.Series(x).sort_index()
    pair = pd.DataFrame({"y": pd.Series(y).reindex(s.index), "x": s.shift(lag)}).dropna()
    if len(pair) < 2 or pair.y.nunique() < 2 or pair.x.nunique() < 2:
        return None
    return abs(np.corrcoef(pair.y, pair.x)[0, 1])


@pytest.fixture(scope="module")
def data(panel_of):
    rng = np.random.default_rng(3)
    xs = {f"x{i:02d}": list(rng.normal(10, 3, 60)) for i in range(8)}
    xs["const"] = [5.1] * 60
    xs["short"] = [None] * 25 + list(rng.normal(0, 1, 35))
    base = np.array(xs["x03"])
    ys = {
        "a": list(20 + np.concatenate([rng.normal(0, 1, 4), base[:-4]]) * 2 + rng.normal(0, 0.3, 60)),
        "b": list(rng.normal(5, 1, 50)) + [None] * 10,
        "c": list(
            np.concatenate([rng.normal(0, 1, 3), np.array(xs["x01"])[:-3]])
            + np.concatenate([rng.normal(0, 1, 5), np.array(xs["x06"])[:-5]])
            + rng.normal(0, 0.2, 60)
        ),
    }
    y = panel_of(ys).filter("y is not null")
    x = panel_of(xs, value="x").filter("x is not null")
    plain = lambda d: {k: {month(i): v for i, v in enumerate(vs) if v is not None} for k, vs in d.items()}
    return y, x, plain(ys), plain(xs)


def test_lag_corr_against_brute_force(data):
    y, x, ys, xs = data
    got = {(r.id_y, r.id_x, r.lag): r["corr"] for r in selection.lag_corr(y, x, 0, 9).collect()}
    assert len(got) == len(ys) * len(xs) * 10
    for (iy, ix, lag), c in got.items():
        want = brute_corr(ys[iy], xs[ix], lag)
        assert (c is None) == (want is None), (iy, ix, lag)
        if want is not None:
            assert c == pytest.approx(want, abs=1e-9)


def test_best_lag_and_blocks(data, monkeypatch):
    y, x, ys, xs = data
    one = sorted(tuple(r) for r in selection.best_lag(y, x, 0, 9).collect())
    for iy, ix, lag, c in one:
        scores = [brute_corr(ys[iy], xs[ix], k) for k in range(10)]
        assert c == pytest.approx(max(s for s in scores if s is not None))
        assert scores[lag] == pytest.approx(c)
    assert not any(r[1] == "const" for r in one)
    assert len(one) == len(ys) * (len(xs) - 1)
    monkeypatch.setattr(selection, "BLOCK", 2)  # many small blocks give the same pairs
    many = sorted(tuple(r) for r in selection.best_lag(y, x, 0, 9).collect())
    assert [r[:3] for r in many] == [r[:3] for r in one]
    assert [r[3] for r in many] == pytest.approx([r[3] for r in one])


def test_smallest_lag_wins_a_tie(panel_of):
    x = panel_of({"x": [1, -1] * 12}, value="x")
    y = panel_of({"y": [2, -2] * 12})
    assert selection.best_lag(y, x, 2, 9).first()["lag"] == 2


def information(rss: float, n: int, p: int, method: str) -> float:
    """The score of a least-squares fit, from its definition as a density of the residuals."""
    spread = (rss / n) ** 0.5
    per_row = -np.log(spread) - 0.5 * np.log(2 * np.pi) - 0.5
    free = n - p - 1
    penalty = 2 * p + (selection.NO_FREEDOM_PENALTY if free == 0 else 2 * p * (p + 1) / free * (method == "AICc"))
    return 2 * n * per_row - penalty


def candidate_table(target: pd.Series, chosen: pd.DataFrame, lagged: pd.DataFrame, method: str) -> pd.Series:
    """Score of every lagged column when it joins the chosen ones."""
    scores = {}
    for name in lagged.columns.difference(chosen.columns):
        rows = pd.concat([target.rename("target"), chosen, lagged[name]], axis=1, join="inner").dropna()
        design = np.insert(rows.drop(columns="target").to_numpy(), 0, 1, axis=1)
        fit = np.linalg.lstsq(design, rows["target"].to_numpy(), rcond=None)[0]
        rss = float(((rows["target"] - design @ fit) ** 2).sum())
        n, p = len(rows), design.shape[1] - 1
        if method == "R2-adj":
            tss = float(((rows["target"] - rows["target"].mean()) ** 2).sum())
            scores[name] = 1 - rss / tss * (n - p) / (n - p - 1)
        else:
            scores[name] = information(rss, n, p, method)
    return pd.Series(scores, dtype=float)


def brute_forward(y: dict, xs: dict, lags: dict, method: str, most: int):
    """Rounds of the table above: take its best row as long as it beats the round before."""
    target = pd.Series(y).sort_index()
    lagged = pd.DataFrame({k: pd.Series(xs[k]).sort_index().shift(lags[k]) for k in lags})
    picked, before = [], selection.START_SCORE
    while len(picked) < most:
        table = candidate_table(target, lagged[picked], lagged, method)
        if table.empty or table.max() <= before:
            break
        picked.append(table.idxmax())
        before = table.max()
    return picked


@pytest.mark.parametrize("name", ["aicc01", "aic01", "r2adj01"])
def test_forward_selection_against_brute_force(data, name):
    y, x, ys, xs = data
    lags = selection.best_lag(y, x, 0, 9)
    table = {}
    for r in lags.collect():
        table.setdefault(r.id_y, {})[r.id_x] = r.lag
    got = selection.fit(name, y, x, lags, max_features=5).collect()
    for iy in ys:
        mine = [r.id_x for r in sorted((r for r in got if r.id_y == iy), key=lambda r: r.step)]
        assert mine == brute_forward(ys[iy], xs, table[iy], selection.METHODS[name], 5), iy
        assert all(table[iy][r.id_x] == r.lag for r in got if r.id_y == iy)


def test_score_penalty_without_freedom():
    x = np.array([[[1.0], [2.0]]])
    assert selection.ols_scores(x, np.array([1.0, 1.5]), "AICc")[0] < -99000 or np.isnan(
        selection.ols_scores(x, np.array([1.0, 1.5]), "AICc")[0]
    )


def test_prepare_x_drops_short_series_and_reports(panel_of):
    x = panel_of({"long": range(1, 40), "short": range(1, 20)}, value="x")
    kept = selection.prepare_x(x, "m", True, 20)
    assert {r.id for r in kept.select("id").distinct().collect()} == {"long"}
    assert kept.count() == 27
    assert tuple(selection.x_report(x, kept).first()) == (2, 1)


def test_hot_join_equals_a_plain_join(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a")
    )
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("b"))
    want = sorted(tuple(r) for r in left.join(right, "k").collect())
    got = sorted(tuple(r) for r in skew.hot_join(left, right, ["k"], ["a"], hot_rows=100).select("k", "a", "b").collect())
    assert got == want
    counted = skew.hot_join(
        left, right.filter("k < 40"), ["k"], ["a"], "left", hot_rows=100, count=left.select("k")
    )
    assert sorted(tuple(r) for r in counted.select("k", "a", "b").fillna(-1).collect()) == sorted(
        tuple(r) for r in left.join(right.filter("k < 40"), "k", "left").fillna(-1).collect()
    )
