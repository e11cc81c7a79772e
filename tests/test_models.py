import itertools

import numpy as np
import pytest
from calendar_helpers import month
from pyspark.sql import functions as F

from tideloom.models import additive, arima, registry, regression, smoothing
from tideloom.operators import panel


def wave(n, seed=0, trend=2.0, season=30.0, noise=2.0):
    t = np.arange(n)
    return 200 + trend * t + season * np.sin(2 * np.pi * t / 12) + np.random.default_rng(seed).normal(0, noise, n)


def log_of(y, names, origin, h=4, **kw):
    req = registry.Request(y, tuple(origin) if isinstance(origin, list) else (origin,), "m", h, **kw)
    return registry.forecast(req, names)


def as_dict(log, *keys):
    return {tuple(r[k] for k in keys): r.forecast for r in log.collect()}


def test_moving_averages_against_brute_force(panel_of):
    y = wave(20)
    got = as_dict(log_of(panel_of({"a": y, "short": [4, 10]}), registry.NATIVE, month(20)), "id", "model", "period")
    for size, n in (("01", 3), ("02", 6), ("03", 12)):
        w = np.arange(1, n + 1)
        a = 1 - 2 / (n + 1)
        decay = a ** np.arange(len(y))[::-1]
        assert got[("a", f"sma{size}", 2)] == pytest.approx(y[-n:].mean())
        assert got[("a", f"wma{size}", 0)] == pytest.approx((y[-n:] * w).sum() / w.sum())
        assert got[("a", f"ema{size}", 3)] == pytest.approx((y * decay).sum() / decay.sum())
    assert got[("a", "snaive01", 1)] == pytest.approx(y[-11])


def test_short_history_guards_and_largest_weights(panel_of):
    y = panel_of({"s": [4, 10]})
    got = as_dict(log_of(y, registry.MODELS, month(2)), "model", "period")
    models = {m for m, _ in got}
    assert {"naive01", "sma03", "wma01", "ema03", "expo01", "expo02"} <= models
    assert not models & {"snaive01", "expo03", "linear01", "linear02", "arima01", "autoarima01", "randomforest01", "xgboost02"}
    assert got[("wma01", 0)] == pytest.approx((4 * 2 + 10 * 3) / 5)
    late = log_of(y, ["naive01"], month(0))
    assert late.count() == 0


def test_seasonal_naive_repeats_beyond_one_season(panel_of):
    y = list(range(12))
    got = as_dict(log_of(panel_of({"a": y}), ["snaive01"], month(12), h=15), "period")
    assert [got[(k,)] for k in range(15)] == y + y[:3]


def plain_smoothing(y, k, p, par):
    """One series, one parameter set, written out step by step."""
    a, b, g = (list(par) + [0, 0])[:3]
    if k == 3:
        level = np.mean(y[:p])
        trend = (np.mean(y[p : 2 * p]) - level) / p
        season, start = [v - level for v in y[:p]], p
    else:
        level, trend, season, start = y[0], (y[1] - y[0] if k == 2 else 0.0), [0.0] * p, 1
    sse = 0.0
    for t in range(start, len(y)):
        s = season[t % p]
        e = y[t] - level - trend - s
        sse += e * e
        old, level = level, level + trend + a * e
        if k > 2:
            season[t % p] = s + g * (y[t] - (old + trend) - s)
        if k > 1:
            trend = trend + b * (level - old - trend)
    return sse, [level + (i + 1) * trend + season[(len(y) + i) % p] for i in range(4)]


@pytest.mark.parametrize("name,k", [("expo01", 1), ("expo02", 2), ("expo03", 3)])
def test_smoothing_is_the_best_of_its_grid(name, k):
    p = 12 if k == 3 else 1
    series = [wave(40, 3), wave(31, 4), wave(40, 5)]
    levels = smoothing.COARSE_LEVELS if k == 3 else smoothing.FINE_LEVELS
    for y, f in zip(series, smoothing.smooth(series, name, 12, 4)):
        coarse = min(itertools.product(levels, repeat=k), key=lambda c: plain_smoothing(y, k, p, c)[0])
        moves = [-0.1, 0, 0.1] if k == 3 else [-0.1, -0.05, 0, 0.05, 0.1]
        near = [tuple(min(max(round(c + m, 2), 0.01), 0.99) for c, m in zip(coarse, ms)) for ms in itertools.product(moves, repeat=k)]
        best = min(near, key=lambda c: plain_smoothing(y, k, p, c)[0])
        assert f == pytest.approx(plain_smoothing(y, k, p, best)[1])


def brute_linear(y, h, x=None):
    """Least squares on the same features, refilled step by step; ``x`` by position or None."""
    y = list(y)
    n = len(y)
    trend = lambda v, t: (v[t - 2] + 2 * v[t - 1] + 2 * v[t] + 2 * v[t + 1] + v[t + 2]) / 8
    dev = [np.mean([y[t] - trend(y, t) for t in range(2, n - 2) if t % 4 == k]) for k in range(4)]
    seas = np.array(dev) - np.mean(dev)

    def features(v, t, with_x):
        one = [float(t % 12 == k) for k in range(12)] + [float(t % 12 // 3 == k) for k in range(4)]
        tr = trend(v, t - 3)
        f = one + [v[t - 1], v[t - 12], (v[t - 12] - v[t - 13]) / v[t - 13], tr, seas[t % 4], v[t - 3] - tr - seas[(t - 3) % 4]]
        return f + ([x[t]] if with_x else [])

    def fit(with_x):
        places = [t for t in range(13, n) if not (with_x and x[t] is None)]
        a = np.array([features(y, t, with_x) for t in places])
        m, s = a.mean(0), a.std(0)
        s[s == 0] = 1
        w = np.linalg.lstsq((a - m) / s, np.array([y[t] for t in places]) - np.mean([y[t] for t in places]), rcond=1e-9)[0]
        return lambda v, t: float((np.array(features(v, t, with_x)) - m) / s @ w + np.mean([y[q] for q in places]))

    plain, rich = fit(False), fit(True) if x is not None else None
    off = x is None
    for _ in range(h):
        off = off or x[len(y)] is None
        y.append(plain(y, len(y)) if off else rich(y, len(y)))
    return y[n:]


def test_linear_model_matches_least_squares_with_recursion(panel_of):
    y = wave(60, 7, noise=9.0)
    got = as_dict(log_of(panel_of({"a": y}), ["linear01"], month(60), h=6), "period")
    want = brute_linear(y, 6)
    assert [got[(k,)] for k in range(6)] == pytest.approx(want, rel=1e-4)


def test_external_model_switches_for_good_when_x_ends(spark, panel_of):
    rng = np.random.default_rng(5)
    xv = rng.normal(50, 10, 60)
    y = wave(60, 8, noise=4.0) + 2 * np.concatenate([np.zeros(2), xv[:-2]])
    x = panel_of({"x1": xv}, value="x")
    lag = spark.createDataFrame([("a", "x1", 2)], "id_y string, id_x string, lag int")
    got = as_dict(log_of(panel_of({"a": y}), ["linearx01"], month(60), h=4, x=x, lag=lag), "period")
    shifted = [None, None, *xv] + [None] * 4  # two steps have x, then it ends
    want = brute_linear(y, 4, shifted)
    assert [got[(k,)] for k in range(4)] == pytest.approx(want, rel=1e-4)
    # later x must not be seen: the origin decides what is known
    longer = panel_of({"x1": list(xv) + [1e6] * 4}, value="x")
    again = as_dict(log_of(panel_of({"a": y}), ["linearx01"], month(60), h=4, x=longer, lag=lag), "period")
    assert again == pytest.approx(got)


X_MODELS = ["linearx01", "linearx02", "arimax01", "arimax02", "autoarimax01", "autoarimax02", "randomforestx01"]


def test_external_models_need_x(spark, panel_of):
    y = panel_of({"a": wave(50)})
    assert log_of(y, X_MODELS, month(50)).count() == 0


def test_external_models_without_a_lag_row_equal_the_plain_ones(spark, panel_of):
    y = panel_of({"a": wave(50)})
    x = panel_of({"x1": wave(50, 3)}, value="x")
    lag = spark.createDataFrame([("other", "x1", 2)], "id_y string, id_x string, lag int")
    got = as_dict(log_of(y, ["linear01", "linearx01", "autoarima01", "autoarimax01"], month(50), x=x, lag=lag), "model", "period")
    for k in range(4):
        assert got[("linearx01", k)] == pytest.approx(got[("linear01", k)])
        assert got[("autoarimax01", k)] == pytest.approx(got[("autoarima01", k)])


def test_arima_recovers_an_autoregression():
    rng = np.random.default_rng(11)
    y = [0.0, 0.0]
    for _ in range(600):
        y.append(0.6 * y[-1] - 0.3 * y[-2] + rng.normal())
    y = np.array(y) + 10
    [f] = arima.forecasts([y], None, 3, 0, arima.Search(4, 1), 3)
    u = y - y.mean()
    want = 0.6 * u[-1] - 0.3 * u[-2] + y.mean()
    assert f[0] == pytest.approx(want, abs=0.3)


def planted(rng, n, phi, theta, season_theta):
    """(1,1,1)(0,1,1) of season 12."""
    e, w = rng.normal(size=n + 214), np.zeros(n + 200)
    for t in range(n + 200):
        w[t] = phi * w[t - 1] * (t > 0) + e[t + 14] + theta * e[t + 13] + season_theta * e[t + 2] + theta * season_theta * e[t + 1]
    v, y = np.cumsum(w[200:]), np.zeros(n)
    for t in range(n):
        y[t] = v[t] + (y[t - 12] if t >= 12 else 20 * np.sin(t))
    return y


def test_arima_recovers_planted_orders():
    rng = np.random.default_rng(3)
    y, n = arima.packed([planted(rng, 400, 0.8, 0.8, -0.5) for _ in range(16)])
    _, orders = arima.batch(y, n, None, 4, None, arima.Search(12, 12))
    assert (orders[:, [1, 4, 5]] == 1).all(axis=1).mean() > 0.85  # both differences and the seasonal error
    kinds, count = np.unique(orders, axis=0, return_counts=True)
    assert kinds[count.argmax()].tolist() == [1, 1, 1, 0, 1, 1]
    # the fit of the known order
    w, m = arima.difference(*arima.difference(y, n, np.ones(16, int), 12), np.ones(16, int), 1)
    order, lags = (1, 1, 0, 1), [*range(1, 13)]
    coef = arima.fitted(w, arima.solved(arima.lag_products(w, arima.long_errors(w, m), lags), order, lags)[0], order, 12)
    assert coef.mean(axis=0) == pytest.approx([0.8, 0.8, -0.5], abs=0.06)


def test_arima_batches_equal_single_series():
    rng = np.random.default_rng(5)
    series = [wave(n, i) for i, n in enumerate((3, 7, 12, 25, 40, 73, 90))] + [np.zeros(30), np.full(9, 4.0), rng.normal(size=50).cumsum()]
    for d, search, need in ((1, None, 3), (0, None, 3), (None, arima.Search(12, 12), 5), (None, arima.Search(4, 4), 5)):
        both = arima.forecasts(series, None, 14, d, search, need)
        for s, f in zip(series, both, strict=True):
            [alone] = arima.forecasts([s], None, 14, d, search, need)
            assert (f is None) == (len(s) < need)
            assert f is None or (np.isfinite(f).all() and f == pytest.approx(alone, rel=1e-5, abs=1e-6))
    flat = arima.forecasts([np.full(9, 4.0), np.arange(40.0)], None, 3, None, arima.Search(12, 12), 5)
    assert flat[0] == pytest.approx([4, 4, 4]) and flat[1] == pytest.approx([40, 41, 42])
    assert arima.forecasts([np.array([1.0, np.nan, 3, 4, 5]), []], None, 3, 1, None, 3) == [None, None]


def test_an_order_is_solved_and_fitted_once_for_all_series_of_a_round(monkeypatch):
    rng = np.random.default_rng(8)
    y, n = arima.packed([rng.normal(size=60).cumsum() for _ in range(200)])
    calls = {"solved": [], "fitted": []}
    for name, at in (("solved", 1), ("fitted", 2)):
        real = getattr(arima, name)
        monkeypatch.setattr(arima, name, lambda *a, real=real, name=name, at=at: calls[name].append(a[at]) or real(*a))
    arima.batch(y, n, None, 4, None, arima.Search(12, 12))
    for name, most in (("solved", 3), ("fitted", 2)):  # calls for an order, about one for each round that asks for it
        assert len(calls[name]) <= most * len(set(calls[name])), name


def test_slopes_are_those_of_single_sets_of_coefficients():
    rng = np.random.default_rng(9)
    for order in ((2, 0, 0, 0), (0, 9, 0, 0), (4, 4, 0, 0), (2, 1, 1, 1)):
        w, coef = rng.normal(size=(3, 50)), rng.uniform(-0.2, 0.2, (3, sum(order)))
        e = arima.errors_of(w, coef, order, 12)
        got = arima.slopes(w, coef, e, order, 12)
        for k in range(sum(order)):
            turned = coef + 1e-6 * (np.arange(sum(order)) == k)
            assert np.array_equal(got[:, k], (arima.errors_of(w, turned, order, 12) - e) / 1e-6)


def test_one_lag_is_a_regression():
    y = wave(50, 3)
    w = np.diff(y)
    a = (w[1:] * w[:-1]).sum() / (w[:-1] ** 2).sum()
    [f] = arima.forecasts([y], None, 4, 1, None, 3, order=(1, 0))
    assert f == pytest.approx(y[-1] + np.cumsum(w[-1] * a ** np.arange(1, 5)))


def test_polynomials_multiply_and_errors_follow_them():
    rng = np.random.default_rng(6)
    coef, order = rng.uniform(-0.6, 0.6, (3, 5)), (2, 1, 1, 1)
    phi, Phi, theta, Theta = coef[:, :2], coef[:, 2], coef[:, 3], coef[:, 4]
    w = rng.normal(size=(3, 40))
    got = arima.errors_of(w, coef, order, 4)
    for r in range(3):
        left = np.convolve([1, *-phi[r]], [1, 0, 0, 0, -Phi[r]])
        right = np.convolve([1, theta[r]], [1, 0, 0, 0, Theta[r]])
        e = np.zeros(40)
        for t in range(40):
            e[t] = sum(left[k] * w[r, t - k] for k in range(len(left)) if k <= t) - sum(right[k] * e[t - k] for k in range(1, len(right)) if k <= t)
        assert got[r] == pytest.approx(e)


def test_reflection_makes_polynomials_stable():
    coef = np.random.default_rng(7).normal(0, 1.5, (200, 4))
    out = arima.reflected(coef)
    for before, after in zip(coef, out, strict=True):
        assert np.abs(np.roots([1, *-after])).max() < 1
        if np.abs(np.roots([1, *-before])).max() < 0.99:
            assert after == pytest.approx(before)


def test_differences_by_tests():
    rng = np.random.default_rng(8)
    t = np.arange(120)
    series = [rng.normal(size=120), rng.normal(size=120).cumsum(), rng.normal(size=120).cumsum().cumsum(), 9 * np.sin(2 * np.pi * t / 12) + rng.normal(size=120), np.full(120, 3.0)]
    plainly, by_season = arima.differences(*arima.packed(series), 12)
    assert plainly.tolist() == [0, 1, 2, 0, 0] and by_season.tolist() == [0, 0, 0, 1, 0]


def test_arimax_uses_its_regressor():
    rng = np.random.default_rng(12)
    x = rng.normal(size=80)
    y = 5 + 3 * x + rng.normal(0, 0.01, 80)
    [f] = arima.forecasts([y[:76]], [[x]], 4, None, arima.Search(2, 1), 3)
    assert f == pytest.approx(5 + 3 * x[76:], abs=0.2)
    # from the first unknown value on, the model without regressors
    ended = np.where(np.arange(80) >= 78, np.nan, x)
    [part] = arima.forecasts([y[:76]], [[ended]], 4, None, arima.Search(2, 1), 3)
    [plain] = arima.forecasts([y[:76]], None, 4, None, arima.Search(2, 1), 3)
    assert part == pytest.approx([*f[:2], *plain[2:]])
    assert arima.forecasts([y[:76]], [[]], 4, None, arima.Search(2, 1), 3)[0] == pytest.approx(plain)


def dense_additive(y, start, ahead):
    """The same regression for one series, column by column."""
    span = len(y)
    knots = np.linspace(0, 0.8, min(25, max(int(span * 0.8) - 1, 0)) + 1)[1:]

    def design(days):
        t = (days - start) / max(span - 1, 1)
        cols = [np.ones(len(days)), t, *(np.maximum(t - k, 0) for k in knots)]
        for period, order, needed in ((365.25, 10, 730), (7.0, 3, 14)):
            if span >= needed:
                cols += [f(2 * np.pi * k * days / period) for k in range(1, order + 1) for f in (np.sin, np.cos)]
        return np.column_stack(cols)

    x = design(np.arange(start, start + span))
    weight = np.diag([0.0, 0.0] + [1.0] * len(knots) + [1e-3] * (x.shape[1] - 2 - len(knots)))
    scale = np.abs(y).max()
    return design(np.arange(start + span, start + span + ahead)) @ np.linalg.solve(x.T @ x + weight, x.T @ (y / scale)) * scale


def test_additive_batches_equal_the_dense_fit():
    rng = np.random.default_rng(9)
    series = [50 + rng.normal(size=n).cumsum() for n in (2, 3, 9, 14, 30, 200, 729, 730, 1500)]
    y, n = arima.packed(series)
    start = np.arange(9) * 100 + 10957
    got = additive.fit_predict(y, n, start, 40)
    for i, s in enumerate(series):
        assert got[i] == pytest.approx(dense_additive(s, int(start[i]), 40), rel=1e-8, abs=1e-8)
    edges = [[int(start[i]) + len(s) + k for k in (0, 31, 40)] for i, s in enumerate(series)]
    sums = additive.summed([*series, [1.0], [1.0, np.inf]], np.append(start, [1, 1]), [*edges, edges[0], edges[0]], 40)
    assert sums[3] == pytest.approx([got[3][:31].sum(), got[3][31:].sum()]) and sums[9:] == [None, None]


def test_additive_model_continues_trend_and_week():
    t = np.arange(200)
    y = 50 + 0.5 * t + 10 * np.sin(2 * np.pi * (t + 3) / 7)
    f = additive.fit_predict(y[None, :186], np.array([186]), np.array([3]), 14)
    assert np.abs(f[0] - y[186:]).max() < 3


def test_models_beat_the_seasonal_naive_on_trend_and_season(panel_of):
    series = {f"s{i}": wave(76, i) for i in range(4)}
    names = ["snaive01", "expo03", "linear01", "autoarima01"]
    log = log_of(panel_of({k: v[:72] for k, v in series.items()}), names, month(72))
    err = {n: [] for n in names}
    for r in log.collect():
        err[r.model].append(abs(r.forecast - series[r.id][72 + r.period]))
    mean = {n: np.mean(e) for n, e in err.items()}
    for n in names[1:]:
        assert mean[n] < mean["snaive01"], mean


def test_additive_model_beats_the_seasonal_naive_on_daily_data(spark):
    y = spark.range(365 * 5).selectExpr(
        "'a' AS id", "date_add(date'2000-01-01', cast(id AS int)) AS ds",
        "20 + id / 50D + 8 * sin(2 * pi() * id / 365.25) + 5 * sin(2 * pi() * id / 7) AS y",
    )
    actual = {r.ds: r.y for r in panel.actuals(y, "m").collect()}
    log = log_of(y, ["snaive01", "prophet01"], month(54))
    err = {}
    for r in log.collect():
        err.setdefault(r.model, []).append(abs(r.forecast - actual[r.ds]))
    assert np.mean(err["prophet01"]) < 0.1 * np.mean(err["snaive01"])


@pytest.fixture(scope="module")
def world(spark, panel_of):
    y = panel_of({"a": wave(64, 1), "b": wave(64, 2, trend=-1)})
    x = panel_of({"x1": wave(64, 9)}, value="x")
    lag = spark.createDataFrame([("a", "x1", 2), ("b", "x1", 3)], "id_y string, id_x string, lag int")
    return y, x, lag


def test_every_model_gives_h_rows_no_null_and_repeats(world):
    y, x, lag = world
    opt = {"trees": 3, "rounds": 2, "depth": 3}
    names = list(registry.MODELS)
    run = lambda some: log_of(y, some, [month(48)], h=2, x=x, lag=lag, options=opt)
    first = as_dict(run(names), "id", "model", "period")
    assert len(first) == len(names) * 2 * 2
    assert all(v is not None and np.isfinite(v) for v in first.values())
    some = ["expo03", "autoarimax01", "linearx01", "randomforest01"]
    again = as_dict(run(some), "id", "model", "period")
    assert again == pytest.approx({k: v for k, v in first.items() if k[1] in some})


def test_no_model_sees_the_future(world):
    y, x, lag = world
    names, opt = list(registry.MODELS), {"trees": 2, "rounds": 2, "depth": 2}
    later = F.col("ds") >= F.lit(month(48))
    y2 = y.withColumn("y", F.when(later, F.col("y") * 7 + 1).otherwise(F.col("y")))
    x2 = x.withColumn("x", F.when(later, F.col("x") * 7 + 1).otherwise(F.col("x")))
    a = as_dict(log_of(y, names, month(48), h=2, x=x, lag=lag, options=opt), "id", "model", "period")
    b = as_dict(log_of(y2, names, month(48), h=2, x=x2, lag=lag, options=opt), "id", "model", "period")
    assert a == pytest.approx(b)


@pytest.mark.parametrize("name", ["randomforest01", "xgboost01"])
def test_tree_forecasts_do_not_depend_on_the_cluster(spark, panel_of, name):
    y = panel_of({f"s{i}": wave(40, i) for i in range(7)})
    opt = {"trees": 3, "rounds": 2, "depth": 3, "series_per_task": 2}
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (3, 8, 12):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(as_dict(log_of(y.repartition(n), [name], month(36), h=2, options=opt), "id", "period"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got[0]) == 14
    assert got[0] == pytest.approx(got[1], rel=1e-12)
    assert got[0] == pytest.approx(got[2], rel=1e-12)


@pytest.mark.parametrize("freq, kind, growth", [("m", "forest", False), ("m", "boost", True), ("q", "boost", False), ("y", "forest", True), ("d", "forest", True)])
def test_one_pass_over_all_steps_equals_a_chain_of_model_transforms(spark, freq, kind, growth):
    from pyspark.ml.functions import array_to_vector

    from tideloom.models import design, trees

    h, opt, rng = 5, {**trees.DEFAULTS, "trees": 4, "rounds": 3, "depth": 3}, np.random.default_rng(8)
    long = {"m": 50, "q": 20, "y": 14, "d": 800}[freq]
    series = [(f"s{i}", 0, int(b0), [0.0 if i == 1 and k % 5 == 0 else float(v) for k, v in enumerate(50 + 9 * np.sin(np.arange(long - i)) + rng.normal(size=long - i))]) for i, b0 in enumerate((8000, 8003, 8005))]
    rows = spark.createDataFrame(series, "id string, s0 int, b0 int, hist array<double>").withColumn("dsr", F.lit(month(60)))
    rows = rows.withColumn("x_ids", F.array(F.lit("p"))).withColumn("xs", F.array(F.transform(F.sequence(F.lit(1), F.size("hist") + 3), lambda k: 10 + k % 7 * 1.0)))
    rows = trees.prepared(rows, freq, h, {"x_columns": 3})
    d = design.Design(freq, growth)
    plain, rich = (trees._train(rows, d, with_x, kind, opt) for with_x in (False, True))
    got = {r.id: r.f for r in trees._walked(rows, d, h, {month(60): (trees.exported(plain, kind), trees.exported(rich, kind))}, True).collect()}
    cur, past = rows.withColumn("past", F.col("hist")), F.col("past")
    for k in range(h):  # the external series ends after three steps
        f = trees._features(d, past, F.size(past), k < 3)
        cur = cur.withColumn("features", array_to_vector(F.transform(f, lambda v: F.coalesce(v, F.lit(0.0)))))
        cur = (rich if k < 3 else plain).transform(cur)
        back = design.anchor_back(F.col("b0") + F.size(past), freq)
        value = (1 + F.col("prediction")) * F.get(past, (F.size(past) - back).cast("int")) if growth else F.col("prediction") * F.col("scale")
        cur = cur.withColumn("past", F.array_append(past, value)).drop("features", "prediction")
    want = {r.id: r.past[-h:] for r in cur.collect()}
    assert len(got) == 3
    for name, f in want.items():
        assert got[name] == pytest.approx(f, rel=1e-9), name


def test_one_bad_series_leaves_the_others_alone(panel_of):
    good = {"a": wave(48, 1), "b": wave(48, 2)}
    bad = {"nan": [float("nan") if i == 20 else v for i, v in enumerate(wave(48, 3))], "huge": [1e300 * (-1) ** i for i in range(48)]}
    names = ["naive01", "sma03", "expo02", "linear01", "arima01", "autoarima01", "prophet01"]
    alone = as_dict(log_of(panel_of(good), names, month(48)), "id", "model", "period")
    req = registry.Request(panel_of({**good, **bad}), (month(48),), "m", 4)
    log = registry.forecast(req, names)
    mixed = as_dict(log, "id", "model", "period")
    assert {k: v for k, v in mixed.items() if k[0] in good} == pytest.approx(alone, rel=1e-6)
    assert all(np.isfinite(v) for v in mixed.values())
    told = {(r.id, r.model): r.text for r in registry.errors(req, names, log).collect()}
    assert {t for (i, _), t in told.items() if i == "nan"} == {"the history has values that are not finite"}
    missing = set(told)
    assert {("nan", n) for n in names} - missing <= {("nan", "naive01"), ("nan", "sma03")}
    assert not {i for i, _ in missing} & set(good)


def test_penalised_fits_converge_whatever_stands_beside_them():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 60, 5))
    x[1, :, 4] = x[1, :, 3] + 0.5 * rng.normal(size=60)  # needs more rounds
    y = x.sum(axis=2) + rng.normal(size=(2, 60))
    gram, moment = np.einsum("bni,bnj->bij", x, x) / 60, np.einsum("bni,bn->bi", x, y) / 60
    both = regression.lasso(gram, moment, 1e-2)
    assert np.array_equal(both[0], regression.lasso(gram[:1], moment[:1], 1e-2)[0])
    for g, m, w in zip(gram, moment, both, strict=True):  # the optimality conditions
        slope = m - g @ w
        assert (np.abs(slope[w == 0]) <= 1e-2 + 1e-6).all()
        assert slope[w != 0] == pytest.approx(1e-2 * np.sign(w[w != 0]), abs=1e-6)


@pytest.mark.parametrize("penalty", [1e-4, 1e-2, 1.0])
def test_penalised_fits_are_optimal_also_for_collinear_columns(penalty):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 48, 20))
    x[:, :, :12] = np.eye(12)[np.arange(48) % 12]  # sums to one
    x[:, :, 14] = x[:, :, 13] + 1e-3 * rng.normal(size=(60, 48))
    x[:, :, 15] = x[:, :, 13] + x[:, :, 12]
    x[:, :, 16] = x[:, :, 17]
    x[:, :, 18] = 3.0
    y = np.einsum("bnp,bp->bn", x, rng.normal(size=(60, 20))) + rng.normal(size=(60, 48))
    y[:20] *= 1e6
    sd = x.std(axis=1, keepdims=True)
    z = (x - x.mean(axis=1, keepdims=True)) / np.where(sd == 0, 1, sd)
    gram, moment = np.einsum("bni,bnj->bij", z, z) / 48, np.einsum("bni,bn->bi", z, y - y.mean(axis=1, keepdims=True)) / 48
    w = regression.lasso(gram, moment, penalty)
    slope, size = moment - np.einsum("bij,bj->bi", gram, w), np.abs(moment).max(axis=1, keepdims=True)
    assert (np.abs(slope) - penalty <= 1e-11 * size).all()
    assert (np.abs(slope - penalty * np.sign(w))[w != 0] <= (1e-11 * size + 0 * w)[w != 0]).all()
    assert not w[:, 18].any()


def test_paths_whose_corners_meet_in_one_point_end():
    rng = np.random.default_rng(6)
    for _ in range(40):  # whole numbers: many columns reach the penalty together
        x = rng.integers(-1, 2, size=(1, 12, 8)).astype(float)
        y = rng.integers(-1, 2, size=(1, 12)).astype(float)
        gram, moment = np.einsum("bni,bnj->bij", x, x), np.einsum("bni,bn->bi", x, y)
        for penalty in (0.5, 1.0, 2.0):
            w = regression.lasso(gram, moment, penalty)
            slope = (moment - np.einsum("bij,bj->bi", gram, w))[0]
            assert (np.abs(slope) <= penalty + 1e-8).all()
            assert slope[w[0] != 0] == pytest.approx(penalty * np.sign(w[0][w[0] != 0]), abs=1e-8)
    assert not regression.lasso(np.eye(3)[None], np.zeros((1, 3)), 1e-4).any()
    assert regression.lasso(np.zeros((0, 3, 3)), np.zeros((0, 3)), 1e-4).shape == (0, 3)


def test_paths_are_followed_without_a_solve_at_every_corner(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(50, 80, 20))
    y = np.einsum("bnp,bp->bn", x, rng.normal(size=(50, 20))) + rng.normal(size=(50, 80))
    gram, moment = np.einsum("bni,bnj->bij", x, x) / 80, np.einsum("bni,bn->bi", x, y) / 80
    real, solves = np.linalg.solve, []
    monkeypatch.setattr(regression.np.linalg, "solve", lambda a, b: solves.append(len(a)) or real(a, b))
    w = regression.lasso(gram, moment, 1e-4)
    corners = (w != 0).sum()
    assert corners > 50 * 15 and sum(solves) < corners / 3
    slope = moment - np.einsum("bij,bj->bi", gram, w)
    assert np.abs(slope - 1e-4 * np.sign(w))[w != 0].max() < 1e-11 and np.abs(slope).max() < 1e-4 + 1e-11


def test_unknown_model_is_an_error(world):
    with pytest.raises(ValueError, match="nosuch"):
        log_of(world[0], ["nosuch"], month(48))


@pytest.mark.parametrize("freq", ["d", "q", "y"])
def test_other_frequencies(spark, freq):
    n = {"d": 1200, "q": 40, "y": 20}[freq]
    step = {"d": "i", "q": "0", "y": "0"}[freq]
    months = {"d": "0", "q": "3 * i", "y": "12 * i"}[freq]
    y = spark.range(n).withColumnRenamed("id", "i").selectExpr(
        "'a' AS id", f"date_add(add_months(date'1990-01-01', cast({months} AS int)), cast({step} AS int)) AS ds",
        "100D + i % 7 + i / 10D AS y",
    )
    last = y.agg(F.max("ds")).first()[0]
    origin = panel.cal.date_of(panel.cal.index_of(last, freq) + 1, freq)
    names = ["naive01", "snaive01", "ema02", "expo02", "arima01", "arima02", "autoarima01", "linear01", "linear02", "prophet01"]
    got = as_dict(registry.forecast(registry.Request(y, (origin,), freq, 3), names), "model", "period")
    assert len(got) == 30 and all(np.isfinite(v) for v in got.values())


def test_reasons_why_there_is_no_forecast(panel_of):
    req = registry.Request(panel_of({"short": wave(4), "long": wave(60)}), (month(60), month(4)), "m", 2)
    names = ["naive01", "snaive01", "expo03", "linear01", "arima02", "autoarima01"]
    log = registry.forecast(req, names)
    told = {(r.id, r.dsr, r.model): r.text for r in registry.errors(req, names, log).collect()}
    assert told[("short", month(4), "snaive01")] == "history of 4 periods, the model needs 12"
    assert told[("long", month(4), "expo03")] == "history of 4 periods, the model needs 24"
    assert told[("long", month(4), "arima02")] == "history of 4 periods, the model needs 15"
    assert not [k for k in told if k[2] == "naive01" or k[:2] == ("long", month(60))]
    yearly = registry.Request(panel_of({"a": wave(60)}), (month(60),), "y", 1)
    [row] = registry.errors(yearly, ["expo03"], registry.forecast(yearly, ["expo03"])).collect()
    assert row.text == "the model needs a frequency with seasons"


@pytest.mark.parametrize("name", ["randomforestx01", "xgboostx01"])
def test_external_series_that_move_against_each_other_are_told_apart(spark, panel_of, name):
    """Two series whose mean never moves, and targets that follow the first one alone."""
    rng = np.random.default_rng(4)
    up = rng.choice([60.0, 140.0], 62)
    y = panel_of({f"s{i}": [3 * v * (i + 1) for v in up[:60]] for i in range(4)})
    x = panel_of({"left": list(up), "right": list(200 - up)}, value="x")
    lag = spark.createDataFrame([(f"s{i}", k, 0) for i in range(4) for k in ("left", "right")], "id_y string, id_x string, lag int")
    shifted = spark.createDataFrame([(f"s{i}", k, 2) for i in range(4) for k in ("left", "right")], "id_y string, id_x string, lag int")
    assert log_of(y, [name], month(60), h=2, x=x, lag=lag).count() == 8
    late = panel_of({f"s{i}": [3 * v * (i + 1) for v in (*up[:2], *up[:58])] for i in range(4)})
    got = as_dict(log_of(late, [name], month(60), h=2, x=x, lag=shifted, options={"trees": 60, "rounds": 30}), "id", "period")
    for i in range(4):
        for k in range(2):  # the value two periods back decides
            low, high = 180 * (i + 1), 420 * (i + 1)
            want = 3 * up[58 + k] * (i + 1)
            assert abs(got[(f"s{i}", k)] - want) < 0.3 * (high - low), (i, k)


def test_external_columns_add_up_and_keep_unknown_positions(spark):
    from tideloom.models import trees

    rows = spark.createDataFrame([("a", [1.0, 2.0], ["p", "p"], [[2.0, 4.0, None], [10.0, 30.0, 20.0]]), ("b", [1.0, 2.0], [], [])], "id string, hist array<double>, x_ids array<string>, xs array<array<double>>")
    got = {r.id: r.x_cols for r in trees._x_columns(rows, 1, 3).collect()}
    assert sorted(got["a"], key=str) == [[0.0] * 3, [0.0] * 3, [pytest.approx(2 / 3 + 0.5), pytest.approx(4 / 3 + 1.5), None]]
    assert got["b"] == [[0.0] * 3] * 3
