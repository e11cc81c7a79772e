import datetime as dt
import statistics

import pytest
from calendar_helpers import month

from tideloom.operators import accuracy

LOG = "id string, ds date, dsr date, period int, model string, forecast double"


def shift(d: dt.date, n: int) -> dt.date:
    i = d.year * 12 + d.month - 1 + n
    return dt.date(i // 12, i % 12 + 1, 1)


def brute_rank(log, act, test_back=6, ens=statistics.fmean, shown="mape"):
    """The definition, one rank origin and one group at a time."""
    out = {}
    for i in sorted({shift(r[2], 1) for r in log}):
        groups, evidence = {}, {}
        for s, ds, dsr, period, model, f in log:
            if dsr < i and ds >= shift(i, -test_back):
                a = act.get((s, ds)) if ds < i else None
                groups.setdefault((s, period, model), []).append((a, f))
                evidence[period] = evidence.get(period, False) or a is not None
        err = {}
        for k, pairs in groups.items():
            known = [(a, f) for a, f in pairs if a is not None]
            mae = ens([abs(a - f) for a, f in known]) if known else None
            mape = ens([0.0 if a == f == 0 else 1.0 if a == 0 else abs((a - f) / a) for a, f in known]) if known else None
            err[k] = (mae, mae if shown == "mae" else mape, len(known) or None)
        for (s, period, model), (mae, disp, n) in err.items():
            peers = sorted({e[0] for (s2, p2, _), e in err.items() if (s2, p2) == (s, period) and e[0] is not None})
            rank = 1 if not evidence[period] else (peers.index(mae) + 1 if mae is not None else None)
            out[(s, i, period, model)] = (rank, disp, n)
    return out


def brute_ensemble(fc, rank, top=3, ens=statistics.fmean):
    out = {}
    for s, dsr in {(r[0], r[2]) for r in fc}:
        mine = [r for r in fc if (r[0], r[2]) == (s, dsr)]
        got = {(r[3], r[4]): rank.get((s, dsr, r[3], r[4]), (None, None, None)) for r in mine}
        none = all(v[0] is None for v in got.values())
        for period in {r[3] for r in mine}:
            here = [r for r in mine if r[3] == period]
            levels = sorted({got[(period, r[4])][0] for r in here} - {None})
            place = {r[4]: 1 if none else (levels.index(got[(period, r[4])][0]) + 1 if got[(period, r[4])][0] is not None else 99) for r in here}
            keep = sorted((place[r[4]], r[4], r[5], *got[(period, r[4])][1:]) for r in here if place[r[4]] <= top)
            if keep:
                errors = [k[3] for k in keep if k[3] is not None]
                backs = [k[4] for k in keep if k[4] is not None]
                out[(s, here[0][1], dsr, period)] = (
                    ens([k[2] for k in keep]),
                    ens(errors) if errors else None,
                    [k[1] for k in keep],
                    statistics.fmean(backs) if backs else None,
                )
    return out


@pytest.fixture
def case(spark):
    log, act = [], {}
    for s, n in (("a", 20), ("ended", 9), ("zero", 20)):
        for m in range(n):
            act[(s, month(m))] = 0.0 if s == "zero" and m % 2 else 100.0 + 7 * m % 13
    for s in ("a", "ended", "zero", "new"):
        for o in range(8, 14):
            for period in range(4):
                for j, model in enumerate(["m1", "m2", "tie2", "m3", "m4"]):
                    f = 0.0 if (s == "zero" and model == "m1") else 90.0 + (3 * min(j, 2) if model == "tie2" or j == 1 else 5 * j) + o % 3
                    if model == "tie2":
                        f = 93.0 + o % 3
                    if model == "m2":
                        f = 93.0 + o % 3
                    log.append((s, month(o + period), month(o), period, model, f))
    actual = spark.createDataFrame([(s, d, v) for (s, d), v in act.items()], "id string, ds date, y double")
    return log, act, spark.createDataFrame(log, LOG), actual


@pytest.mark.parametrize("ens,fn,shown", [("mean", statistics.fmean, "mape"), ("median", statistics.median, "mae")])
def test_rank_and_ensemble_against_brute_force(case, ens, fn, shown):
    log, act, dlog, dact = case
    want = brute_rank(log, act, ens=fn, shown=shown)
    ranked = accuracy.rank_models(dlog, dact, "m", error_ens=ens, error_dsp=shown)
    got = {(r.id, r.dsr, r.period, r.model): (r["rank"], r.error, r.test_back) for r in ranked.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][2] == want[k][2], k
        assert got[k][1] == pytest.approx(want[k][1])
    combined = accuracy.ensemble_log(dlog, ranked, top_model=2, fcst_ens=ens, error_ens=ens)
    got = {(r.id, r.ds, r.dsr, r.period): (r.forecast, r.error, r.top_model, r.test_back) for r in combined.collect()}
    want = brute_ensemble(log, want, top=2, ens=fn)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][2] == want[k][2], k
        assert got[k][0] == pytest.approx(want[k][0])
        assert got[k][1] == pytest.approx(want[k][1]) and got[k][3] == pytest.approx(want[k][3])


def test_errors_at_zero(spark):
    log = spark.createDataFrame(
        [("a", month(i), month(0), i, "m", f) for i, f in enumerate([0.0, 5.0, 5.0, 5.0])], LOG
    )
    act = spark.createDataFrame([("a", month(0), 0.0), ("a", month(1), 0.0), ("a", month(2), -4.0)], "id string, ds date, y double")
    got = [(r.mae, r.mape) for r in accuracy.score_log(log, act).orderBy("ds").collect()]
    assert got == [(0.0, 0.0), (5.0, 1.0), (9.0, 2.25), (None, None)]


def test_ensemble_of_one_model_is_the_model(case):
    _, _, dlog, dact = case
    one = dlog.filter("model = 'm1'")
    ens = accuracy.ensemble_log(one, accuracy.rank_models(one, dact, "m"))
    both = ens.join(one.withColumnRenamed("forecast", "f"), ["id", "ds", "dsr", "period"])
    assert both.filter("forecast <> f").count() == 0
    # at origins with a rank, a period whose model has no rank gives no row
    assert both.count() == ens.count() > 0


def test_log_rows_meet_their_rank_origins_after_the_exchange(case):
    _, _, dlog, dact = case
    plan = accuracy.rank_models(dlog, dact, "m")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence") < plan.index("RepartitionByExpression")
