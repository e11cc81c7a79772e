"""Feature selection: for every target the external series and lag that explain it best.

Scoring compares every target with every external series, so the work is the product of the
two. It is laid out as a blocked matrix product: targets and external series are hashed into
blocks of bounded size, every block pair is one task, and inside it all pairs and lags are
dense matrix products. Rows are replicated once per opposite block, never once per pair.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..session import cut_lineage
from . import growth as gr
from .skew import hot_join

BLOCK = 256  # series per block; one task holds two blocks of packed series

# Selection method names and their score.
METHODS = {"aicc01": "AICc", "aic01": "AIC", "r2adj01": "R2-adj"}
START_SCORE = -999999.0
NO_FREEDOM_PENALTY = 99999.0


# -- preparation ------------------------------------------------------------------------


def clean_after_gap(df: DataFrame, freq: str, value: str = "x") -> DataFrame:
    """Duplicates summed; everything up to the last missing bucket start is dropped."""
    s = df.groupBy("id", "ds").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    whole = Window.partitionBy("id")
    ds = F.col("ds")
    on_start = cal.bucket(ds, freq) == ds
    newest_first = Window.partitionBy("id").orderBy(F.desc("ds"))
    s = s.withColumns(
        {
            "_idx": cal.period_index(ds, freq),
            "_lo": F.min("ds").over(whole),
            "_top": cal.period_index(F.max("ds").over(whole), freq),
            "_seen": F.sum(on_start.cast("int")).over(newest_first),
        }
    )
    # the unbroken run of bucket starts that ends at the newest bucket
    in_run = on_start & (F.col("_idx") == F.col("_top") - F.col("_seen") + 1)
    run_start = F.coalesce(F.min(F.when(in_run, F.col("_idx"))).over(whole), F.col("_top") + 1)
    s = s.withColumn("_gap", run_start - 1)
    complete = F.col("_gap") < cal.horizon_index(F.col("_lo"), freq)
    return s.filter(complete | (ds > cal.period_start_date(F.col("_gap"), freq))).select(
        "id", "ds", value
    )


def prepare_y(y: DataFrame, freq: str, growth: bool = True) -> DataFrame:
    y = clean_after_gap(y, freq, "y")
    return gr.pct_change(y, freq, "y") if growth else y


def prepare_x(
    x: DataFrame, freq: str, growth: bool = True, min_data_points: int = 72
) -> DataFrame:
    """Cleaned external series with at least ``min_data_points`` points."""
    x = clean_after_gap(x, freq, "x")
    x = gr.pct_change(x, freq, "x") if growth else x
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return x.withColumn("_n", n).filter(F.col("_n") >= min_data_points).drop("_n")


def x_report(x: DataFrame, kept: DataFrame) -> DataFrame:
    """How many external series were given and how many are usable."""
    all_ids = x.select("id", F.lit(None).cast("string").alias("kept"))
    kept_ids = kept.select("id", F.col("id").alias("kept"))
    return all_ids.unionByName(kept_ids).agg(
        F.count_distinct("id").alias("total_x"), F.count_distinct("kept").alias("total_test_x")
    )


def align_lagged(
    y: DataFrame, x: DataFrame, lags: DataFrame
) -> DataFrame:
    """Rows ``id_y, id_x, lag, ds, y, x`` on the dates of x, x shifted by ``lag`` rows, complete rows only."""
    rn = F.row_number().over(Window.partitionBy("id").orderBy("ds"))
    pos = x.select(F.col("id").alias("id_x"), "ds", "x", rn.alias("pos"))
    targets = hot_join(lags, pos.select("id_x", "ds", "pos"), ["id_x"], ["id_y"]).withColumn(
        "src", F.col("pos") - F.col("lag")
    )
    values = pos.select("id_x", F.col("pos").alias("src"), "x")
    shifted = hot_join(targets, values, ["id_x", "src"], ["id_y"], count=lags)
    return (
        shifted.join(y.select(F.col("id").alias("id_y"), "ds", "y"), ["id_y", "ds"])
        .select("id_y", "id_x", "lag", "ds", "y", "x")
        .dropna()
    )


# -- blocks -----------------------------------------------------------------------------


def _packed(df: DataFrame, value: str, key: str) -> DataFrame:
    """One row per series: sorted day numbers and values (bounded by the calendar)."""
    cells = F.array_sort(F.collect_list(F.struct(F.unix_date("ds").alias("d"), F.col(value).alias("v"))))
    return (
        df.groupBy(F.col("id").alias(key))
        .agg(cells.alias("_c"))
        .select(key, F.col("_c.d").alias("days"), F.col("_c.v").alias("vals"))
    )


def _written(packed: DataFrame) -> tuple[DataFrame, int]:
    """Packed series as a written table, and how many blocks they fill."""
    table = cut_lineage(packed)
    return table, max(1, math.ceil(table.count() / BLOCK))


def _block(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _all_blocks(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _on_axis(days: np.ndarray, axis: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """Values placed on a sorted day axis, NaN elsewhere; days off the axis are ignored."""
    out = np.full(len(axis), np.nan)
    pos = np.searchsorted(axis, days)
    pos = np.minimum(pos, len(axis) - 1)
    hit = axis[pos] == days
    out[pos[hit]] = vals[hit]
    return out


def _pair_moments_corr(ym: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """|Pearson| over pairwise complete columns for all rows of ``ym`` x ``xm``; NaN if undefined."""
    my, mx = ~np.isnan(ym), ~np.isnan(xm)
    y0 = np.where(my, ym - np.nanmean(np.where(my, ym, np.nan), axis=1, keepdims=True), 0.0)
    x0 = np.where(mx, xm - np.nanmean(np.where(mx, xm, np.nan), axis=1, keepdims=True), 0.0)
    my, mx = my.astype(float), mx.astype(float)
    n = my @ mx.T
    sy, sx = y0 @ mx.T, my @ x0.T
    syy, sxx = (y0 * y0) @ mx.T, my @ (x0 * x0).T
    vy, vx = n * syy - sy * sy, n * sxx - sx * sx
    ok = (n > 1) & (vy > 1e-12 * n * syy) & (vx > 1e-12 * n * sxx)
    cov = n * (y0 @ x0.T) - sy * sx
    corr = np.abs(cov) / np.sqrt(np.where(ok, vy * vx, 1.0))
    return n, np.where(ok, np.round(np.minimum(corr, 1.0), 12), np.nan)


def _corr_block(min_lag: int, max_lag: int, best_only: bool):
    def run(_, yb: pd.DataFrame, xb: pd.DataFrame) -> pd.DataFrame:
        cols = ["id_y", "id_x", "lag", "n", "corr"]
        if yb.empty or xb.empty:
            return pd.DataFrame(columns=cols)
        axis = np.unique(np.concatenate(list(xb["days"])))
        with np.errstate(all="ignore"):
            ym = np.stack([_on_axis(d, axis, v) for d, v in zip(yb["days"], yb["vals"])])
            # a target without any date on the axis has no correlation
            lags = range(min_lag, max_lag + 1)
            corr = np.full((len(lags), len(yb), len(xb)), np.nan)
            count = np.zeros_like(corr)
            for k, lag in enumerate(lags):
                xm = np.stack(
                    [
                        _on_axis(d[lag:], axis, v[: max(len(v) - lag, 0)])
                        for d, v in zip(xb["days"], xb["vals"])
                    ]
                )
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore", RuntimeWarning)
                    count[k], corr[k] = _pair_moments_corr(ym, xm)
        iy, ix = np.meshgrid(np.arange(len(yb)), np.arange(len(xb)), indexing="ij")
        if best_only:
            best = np.argmax(np.where(np.isnan(corr), -1.0, corr), axis=0)
            k, i, j = best.ravel(), iy.ravel(), ix.ravel()
        else:
            k, i, j = (
                a.ravel()
                for a in np.meshgrid(
                    np.arange(len(lags)), np.arange(len(yb)), np.arange(len(xb)), indexing="ij"
                )
            )
        out = pd.DataFrame(
            {
                "id_y": yb["id_y"].to_numpy()[i],
                "id_x": xb["id_x"].to_numpy()[j],
                "lag": k + min_lag,
                "n": count[k, i, j].astype("int64"),
                "corr": corr[k, i, j],
            }
        )
        if best_only:
            return out[out["corr"].notna()]
        out["corr"] = out["corr"].astype(object).where(out["corr"].notna(), None)
        return out

    return run


def _correlate(
    y: DataFrame, x: DataFrame, min_lag: int, max_lag: int, best_only: bool
) -> DataFrame:
    yp, ny = _written(_packed(y, "y", "id_y"))
    xp, nx = _written(_packed(x, "x", "id_x"))
    left = yp.withColumn("yb", _block("id_y", ny)).withColumn("xb", _all_blocks(nx))
    right = xp.withColumn("xb", _block("id_x", nx)).withColumn("yb", _all_blocks(ny))
    return (
        left.groupBy("yb", "xb")
        .cogroup(right.groupBy("yb", "xb"))
        .applyInPandas(
            _corr_block(min_lag, max_lag, best_only),
            "id_y string, id_x string, lag int, n bigint, corr double",
        )
    )


def lag_corr(y: DataFrame, x: DataFrame, min_lag: int = 2, max_lag: int = 23) -> DataFrame:
    """|Pearson| of y with x shifted by each lag, on the dates of x, NULL where undefined."""
    return _correlate(y, x, min_lag, max_lag, best_only=False)


def best_lag(y: DataFrame, x: DataFrame, min_lag: int = 2, max_lag: int = 23) -> DataFrame:
    """Lag of the highest correlation per pair, the smallest on ties; undefined never wins."""
    return _correlate(y, x, min_lag, max_lag, best_only=True).select(
        "id_y", "id_x", "lag", "corr"
    )


# -- scoring ----------------------------------------------------------------------------


def ols_scores(design: np.ndarray, y: np.ndarray, method: str) -> np.ndarray:
    """Scores of a batch of regressions with intercept; NaN rows of a design are left out.

    ``design`` is (batch, rows, p), ``y`` (rows,). Columns are centred per regression.
    """
    use = ~np.isnan(design).any(axis=2) & ~np.isnan(y)[None, :]
    w = use.astype(float)
    n = w.sum(axis=1)
    p = design.shape[2]
    with np.errstate(all="ignore"):
        x = np.where(use[:, :, None], design, 0.0)
        t = np.where(use, y[None, :], 0.0)
        x = (x - (x.sum(axis=1) / n[:, None])[:, None, :]) * w[:, :, None]
        t = (t - (t.sum(axis=1) / n)[:, None]) * w
        x, t = np.nan_to_num(x), np.nan_to_num(t)
        gram = np.einsum("bip,biq->bpq", x, x)
        moment = np.einsum("bip,bi->bp", x, t)
        coef = np.einsum("bpq,bq->bp", np.linalg.pinv(gram, hermitian=True), moment)
        rss = ((t - np.einsum("bip,bp->bi", x, coef)) ** 2).sum(axis=1)
        tss = (t * t).sum(axis=1)
        rss = np.maximum(rss, 1e-30 * tss)  # a perfect fit scores very high, not undefined
        free = n - p - 1
        if method == "R2-adj":
            r2 = 1 - rss / tss
            score = np.where(free != 0, 1 - (1 - r2) * (n - p) / free, np.nan)
        else:
            twice_likelihood = -n * (np.log(2 * np.pi * rss / n) + 1)  # of normal errors, at its maximum
            extra = 2 * p * (p + 1) / free if method == "AICc" else np.zeros_like(n)
            score = twice_likelihood - 2 * p - np.where(free == 0, NO_FREEDOM_PENALTY, extra)
    return np.where((n > 0) & np.isfinite(score), score, np.nan)


def _score_block(method: str, best_only: bool):
    def run(_, yb: pd.DataFrame, xb: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        series = {i: (d, v) for i, d, v in zip(xb["id_x"], xb["days"], xb["vals"])}
        for id_y, days, cols, lags in zip(yb["id_y"], yb["days"], yb["cols"], yb["lags"]):
            cand = sorted((i, k) for i, k in dict(lags).items() if i in series)
            if not cand:
                continue
            f = np.stack(list(cols))  # (rows, 1 + chosen): y first
            new = np.stack(
                [
                    _on_axis(series[i][0][k:], days, series[i][1][: max(len(series[i][1]) - k, 0)])
                    for i, k in cand
                ]
            )
            chosen = np.broadcast_to(f[None, :, 1:], (len(cand), *f[:, 1:].shape))
            score = ols_scores(np.concatenate([chosen, new[:, :, None]], axis=2), f[:, 0], method)
            found = [(id_y, i, k, float(s)) for (i, k), s in zip(cand, score) if not np.isnan(s)]
            rows += [max(found, key=lambda r: r[3])] if best_only and found else found
        return pd.DataFrame(rows, columns=["id_y", "id_x", "lag", "score"])

    return run


def _score(
    state: DataFrame, x_packed: DataFrame, lags: DataFrame, method: str, ny: int, nx: int, best_only: bool
) -> DataFrame:
    """Score every candidate of ``lags`` added to the columns already in ``state``."""
    cells = F.array_sort(F.collect_list(F.struct(F.unix_date("ds").alias("d"), "f")))
    packed = (
        state.groupBy("id_y")
        .agg(cells.alias("_c"))
        .select("id_y", F.col("_c.d").alias("days"), F.col("_c.f").alias("cols"))
    )
    per_block = (
        lags.withColumn("xb", _block("id_x", nx))
        .groupBy("id_y", "xb")
        .agg(F.map_from_entries(F.collect_list(F.struct("id_x", "lag"))).alias("lags"))
    )
    left = packed.join(per_block, "id_y").withColumn("yb", _block("id_y", ny))
    right = x_packed.withColumn("xb", _block("id_x", nx)).withColumn("yb", _all_blocks(ny))
    return (
        left.groupBy("yb", "xb")
        .cogroup(right.groupBy("yb", "xb"))
        .applyInPandas(
            _score_block(method, best_only), "id_y string, id_x string, lag int, score double"
        )
    )


def _start(y: DataFrame) -> tuple[DataFrame, int]:
    """State before the first round (``f`` holds y alone), and the number of target blocks."""
    state = cut_lineage(y.select(F.col("id").alias("id_y"), "ds", F.array(F.col("y")).alias("f")))
    n = state.select("id_y").distinct().count()
    return state, max(1, math.ceil(n / BLOCK))


def score_first(y: DataFrame, x: DataFrame, lags: DataFrame, method: str = "AICc") -> DataFrame:
    """Scores of all one-feature regressions: the first round of the forward selection."""
    xp, nx = _written(_packed(x, "x", "id_x"))
    state, ny = _start(y)
    return _score(state, xp, lags.select("id_y", "id_x", "lag"), method, ny, nx, best_only=False)


def _extend_state(state: DataFrame, chosen: DataFrame, x_packed: DataFrame) -> DataFrame:
    """Append the chosen lagged series to each target; rows without it are dropped."""
    col = (
        hot_join(chosen.select("id_y", "id_x", "lag"), x_packed, ["id_x"], ["id_y"])
        .select("id_y", "lag", "vals", F.posexplode("days").alias("pos", "d"))
        .select(
            "id_y",
            F.date_from_unix_date("d").alias("ds"),
            F.get("vals", F.col("pos") - F.col("lag")).alias("v"),
        )
        .filter(F.col("v").isNotNull())
    )
    return state.join(col, ["id_y", "ds"]).select(
        "id_y", "ds", F.array_append("f", F.col("v")).alias("f")
    )


def forward_select(
    y: DataFrame, x: DataFrame, lags: DataFrame, method: str = "AICc", max_features: int = 10
) -> DataFrame:
    """Greedy forward selection for all targets at once: ``id_y, id_x, lag, step, score``.

    One Spark job per round scores every remaining candidate of every target that improved
    in the round before. A candidate must be strictly better than the best score so far.
    Each round is written once to the shared folder, which cuts its lineage.
    """
    x_packed, nx = _written(_packed(x, "x", "id_x"))
    state, ny = _start(y)
    left = cut_lineage(lags.select("id_y", "id_x", "lag"))
    best = left.select("id_y").distinct().withColumn("best", F.lit(START_SCORE))
    rounds: list[DataFrame] = []
    for step in range(1, max_features + 1):
        scored = _score(state, x_packed, left, method, ny, nx, best_only=True)
        top = scored.groupBy("id_y").agg(
            F.min_by(F.struct("id_x", "lag", "score"), F.struct(-F.col("score"), F.col("id_x"))).alias("t")
        )
        chosen = cut_lineage(
            top.select("id_y", "t.*")
            .join(best, "id_y")
            .filter(F.col("score") > F.col("best"))
            .select("id_y", "id_x", "lag", F.lit(step).alias("step"), "score")
        )
        if chosen.isEmpty():
            break
        rounds.append(chosen)
        if step == max_features:
            break
        best = chosen.select("id_y", F.col("score").alias("best"))
        state = cut_lineage(_extend_state(state, chosen, x_packed))
        left = left.join(chosen.select("id_y", "id_x"), ["id_y", "id_x"], "left_anti").join(
            best.select("id_y"), "id_y", "left_semi"
        )
    if not rounds:
        return lags.limit(0).select(
            "id_y", "id_x", "lag", F.lit(0).alias("step"), F.lit(0.0).alias("score")
        )
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def fit(name: str, y: DataFrame, x: DataFrame, lags: DataFrame, max_features: int = 10) -> DataFrame:
    """Selection by method name."""
    if name not in METHODS:
        raise ValueError(f"unknown selection method: {name}")
    return forward_select(y, x, lags, METHODS[name], max_features)
