"""L1-penalised linear models on calendar, lag, decomposition and external features.

Features are built by Spark as arrays on the (id, dsr) row, so neither training nor the
recursive forecast needs a shuffle or a join. Only the small normal equations are solved in
Python, batched over all series of an Arrow batch; the forecast steps are one array fold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import series as sa
from . import design as dz

# Model name -> (growth target, uses external series).
MODELS = {
    "linear01": (False, False),
    "linear02": (True, False),
    "linearx01": (False, True),
    "linearx02": (True, True),
}
PENALTY = 1e-4
SPANNED = 1e-9  # a column with less than this part of its own is spanned by others
CLEAR = 1e-7  # corners that differ by no more than this share aren't told apart after eliminations
CLOSE = 1e-3  # a column that enters with less than this part of its own is eliminated from scratch
TOGETHER = 256  # problems whose paths are followed at once, so that they stay in a core's cache
MIN_BUCKETS = 8


def lasso(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    """Exact minima of ``w'Gw / 2 - m'w + penalty * |w|`` for a batch of standardised problems.

    Follows the path of solutions from the penalty at which all coefficients are zero down to ``penalty``. Between two
    of its corners the solution is linear in the penalty, so the next corner has a closed form: a column enters where its
    correlation with the rest reaches the penalty, and leaves where its coefficient reaches zero. A path has finitely
    many corners, so there is no limit of rounds. Every problem follows its own path; the steps of a round are stacked.

    A column that the active ones span adds nothing and never enters; of equal columns the first carries the coefficient.
    Corners that meet in one point can make a path walk in circles there. Such a path starts again with its moments moved
    apart in the last digits, further with every start; the last stretch uses the given moments again.
    """
    out = np.zeros(moment.shape)
    for at in range(0, len(moment) if moment.size else 0, TOGETHER):
        part = slice(at, at + TOGETHER)
        out[part] = _paths(gram[part], moment[part], penalty)
    return out


def _solved(gram: np.ndarray, moment: np.ndarray, on: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """What a path is followed by, from scratch: for every column its row of (moment, sign, gram) without the active columns' part;
    for an active one the coefficients in it of the moment, of the signs and of the other columns."""
    inner = gram * on[:, :, None] * on[:, None, :] + np.eye(gram.shape[1]) * ~on[:, None, :]
    right = np.concatenate([(moment * on)[:, :, None], sign[:, :, None], gram * on[:, :, None]], axis=2)
    found = np.linalg.solve(inner, right)
    fit, slope, span = found[:, :, 0], found[:, :, 1], found[:, :, 2:]
    left = np.concatenate([(moment - np.einsum("bpq,bq->bp", gram, fit))[:, :, None], -np.einsum("bpq,bq->bp", gram, slope)[:, :, None], gram - gram @ span], axis=2)
    at = np.arange(gram.shape[1])
    left[:, at, at + 2] = np.einsum("bpp->bp", gram) - np.einsum("bpq,bpq->bq", gram, span)
    return np.where(on[:, :, None], found, left)


def _corners(rows: np.ndarray, on: np.ndarray, sign: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The penalties at which each column would enter with a positive or a negative sign, or leave."""
    at = np.arange(rows.shape[1])
    rest, pull = rows[:, :, 0], -rows[:, :, 1]  # the coefficient of an active column is rest + penalty * pull
    free = ~on & (rows[:, at, at + 2] > least)  # what the active columns don't explain of a column
    return np.stack([
        np.where(free & (pull < 1), rest / np.where(pull < 1, 1 - pull, 1), -np.inf),
        np.where(free & (pull > -1), -rest / np.where(pull > -1, 1 + pull, 1), -np.inf),
        np.where(on & (sign * pull > 0), -rest / np.where(pull == 0, 1, pull), -np.inf),
    ], axis=1).reshape(len(rows), -1)


def _paths(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    """lasso() for a few problems. A column that enters is eliminated from the rows of the others. Where one leaves, or enters almost
    spanned, or the next corner isn't clear, the rows are solved from scratch, so that rounding neither adds up nor decides."""
    count, width = moment.shape
    out = np.zeros(moment.shape)
    level = np.abs(moment).max(axis=1)
    live = np.flatnonzero(level > penalty)
    active, sign = np.zeros((count, width), dtype=bool), np.zeros((count, width))
    still, starts = np.zeros(count, dtype=int), np.zeros(count, dtype=int)
    used = moment.copy()
    least = SPANNED * np.maximum(np.einsum("bpp->bp", gram), SPANNED)
    rows = np.concatenate([moment[:, :, None], np.zeros((count, width, 1)), gram], axis=2)[live]
    while len(live):
        on, s, top, each = active[live], sign[live], level[live], np.arange(len(live))
        corners = _corners(rows, on, s, least[live])
        pick = corners.argmax(axis=1)
        first = corners[each, pick]
        corners[each, pick] = -np.inf
        close = (first > penalty) & (corners.max(axis=1) >= first - CLEAR * np.abs(first))
        corners[each, pick] = first
        if close.any():
            at = live[close]
            rows[close] = _solved(gram[at], used[at], on[close], s[close])
            corners[close] = _corners(rows[close], on[close], s[close], least[at])
            pick = corners.argmax(axis=1)
        reached = np.minimum(corners[each, pick], top)
        done = ~(reached > penalty)  # values that aren't finite end as well
        if done.any():
            at, its = live[done], on[done]
            inner = gram[at] * its[:, :, None] * its[:, None, :] + np.eye(width) * ~its[:, None, :]
            exact = np.linalg.solve(inner, ((moment[at] - penalty * s[done]) * its)[:, :, None])[:, :, 0]
            out[at] = np.where(its, exact, 0.0)
            go = ~done
            live, rows, pick, reached, top, each = live[go], rows[go], pick[go], reached[go], top[go], np.arange(go.sum())
        kind, column = np.divmod(pick, width)
        enters = kind < 2
        active[live, column] = enters
        sign[live, column] = np.array([1.0, -1.0, 0.0])[kind]
        still[live] = np.where(reached < top * (1 - 1e-13), 0, still[live] + 1)
        level[live] = reached
        own = rows[each, column, column + 2]
        anew = ~enters | (own < CLOSE)
        rows[each, column, 1] += sign[live, column]
        lead = rows[each, column] / np.where(anew, 1.0, own)[:, None]
        rows -= (rows[each, :, column + 2] * ~anew[:, None])[:, :, None] * lead[:, None, :]
        rows[each, column] = lead
        for i in live[still[live] > 2 * width]:
            starts[i] += 1
            apart = 10.0 ** (starts[i] - 14) * np.random.default_rng(int(starts[i])).uniform(-1, 1, width)
            used[i] = moment[i] + apart * np.abs(moment[i]).max()
            active[i], sign[i], still[i], level[i] = False, 0.0, 0, np.abs(used[i]).max()
            anew |= live == i
        if anew.any():
            at = live[anew]
            rows[anew] = _solved(gram[at], used[at], active[at], sign[at])
    return out


def _equations(num: np.ndarray, cat: np.ndarray, y: np.ndarray, dummies: int):
    """Centred, scaled normal equations of one series; None with fewer than two complete rows."""
    use = ~np.isnan(num).any(axis=1) & ~np.isnan(y)
    if use.sum() < 2:
        return None
    num, cat, y = num[use], cat[use], y[use]
    x = np.zeros((len(y), dummies + num.shape[1]))
    if cat.shape[1]:
        x[np.arange(len(y))[:, None], cat] = 1.0
    x[:, dummies:] = num
    mean, y_mean = x.sum(axis=0) / len(y), y.sum() / len(y)
    z = x - mean
    sd = np.sqrt((z * z).sum(axis=0) / len(y))
    sd[sd == 0] = 1.0
    z /= sd
    return z.T @ z / len(y), z.T @ (y - y_mean) / len(y), mean, sd, y_mean


def fit_rows(num, cat, y, xs, first: int, h: int, n_numeric: int, n_codes: int, dummies: int):
    """Coefficients (intercept, dummies, numeric, external) per series, None where none can be fitted.

    ``xs`` holds the external values of all positions of a series, ``first`` is the first
    training position. Series with equally many columns are solved together.
    """
    out: list[np.ndarray | None] = [None] * len(y)
    by_width: dict[int, list[tuple]] = {}
    for i, (a, c, t, x) in enumerate(zip(num, cat, y, xs)):
        t = np.asarray(t, dtype=float)
        n = len(t)
        if n:
            a = np.asarray(a, dtype=float).reshape(n, n_numeric)
            c = np.asarray(c, dtype=int).reshape(n, n_codes)
            x = np.asarray(x, dtype=float).reshape(-1, first + n + h).T[first : first + n]
            eq = _equations(np.hstack([a, x]) if x.shape[1] else a, c, t, dummies)
            if eq is not None and np.isfinite(np.concatenate(eq, axis=None)).all():
                by_width.setdefault(x.shape[1], []).append((i, *eq))
    for members in by_width.values():
        gram = np.stack([m[1] for m in members])
        w = lasso(gram, np.stack([m[2] for m in members]), PENALTY)
        for (i, _, _, mean, sd, y_mean), row in zip(members, w):
            if not np.isfinite(row).all():
                continue
            row = row / sd
            out[i] = np.concatenate([[y_mean - row @ mean], row])
    return out


def _coefficients(rows: DataFrame, d: dz.Design, h: int, with_x: bool, out: str) -> DataFrame:
    """Add the fitted coefficients of one model to every (id, dsr) row."""
    n_codes, dummies = len(dz.PARTS[d.freq]), dz.n_dummies(d.freq)

    @F.pandas_udf("array<double>")
    def solve(num: pd.Series, cat: pd.Series, y: pd.Series, xs: pd.Series) -> pd.Series:
        coef = fit_rows(num, cat, y, xs, d.first, h, d.n_numeric, n_codes, dummies)
        return pd.Series(coef, dtype=object)

    hist, b0, seas = F.col("hist"), F.col("b0"), F.col("seas")
    pos = d.positions(hist)
    num = F.flatten(F.transform(pos, lambda t: F.array(*d.numeric(hist, t, b0, seas))))
    cat = F.array().cast("array<int>")
    if n_codes:
        cat = F.flatten(F.transform(pos, lambda t: F.array(*dz.codes(b0 + t, d.freq))))
    y = F.transform(pos, lambda t: d.target(hist, t, b0))
    xs = F.flatten("xs") if with_x else F.array().cast("array<double>")
    return rows.withColumn(out, solve(num, cat, y, xs))


def _predict(coef: Column, d: dz.Design, hist: Column, t: Column, b0: Column, seas: Column, extra: Column | None):
    dummies = dz.n_dummies(d.freq)
    value = sa.at(coef, 0)
    for code in dz.codes(b0 + t, d.freq):
        value = value + sa.at(coef, code + 1)
    numeric = d.numeric(hist, t, b0, seas)
    for j, v in enumerate(numeric):
        value = value + sa.at(coef, 1 + dummies + j) * v
    if extra is not None:
        tail = F.slice(coef, 2 + dummies + len(numeric), F.greatest(F.size(extra), F.lit(0)))
        value = value + sa.dot(tail, extra)
    if d.growth:
        value = (1 + value) * sa.at(hist, t - dz.anchor_back(b0 + t, d.freq))
    return value


def _fold(d: dz.Design, h: int, coef: Column, coefx: Column | None) -> Column:
    """Recursive forecast: each step appends its prediction to the history.

    With external series the second model takes over for good at the first unknown value.
    """
    hist, b0, seas = F.col("hist"), F.col("b0"), F.col("seas")
    start = F.struct(hist.alias("hist"), F.lit(False).alias("off"))

    def step(acc, _):
        past = acc["hist"]
        t = F.size(past)
        if coefx is None:
            value = _predict(coef, d, past, t, b0, seas, None)
            return F.struct(F.array_append(past, value).alias("hist"), acc["off"].alias("off"))
        extra = F.transform("xs", lambda x: sa.at(x, t))
        off = acc["off"] | F.exists(extra, lambda v: v.isNull())
        value = F.when(off, _predict(coef, d, past, t, b0, seas, None)).otherwise(
            _predict(coefx, d, past, t, b0, seas, extra)
        )
        return F.struct(F.array_append(past, value).alias("hist"), off.alias("off"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(h)),
        start,
        step,
        lambda acc: F.slice(acc["hist"], F.size(hist) + 1, h),
    )


def expressions(rows: DataFrame, names: Sequence[str], freq: str, h: int) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with the fitted coefficients added, and the forecast array of every model."""
    rows = dz.with_seasonal_means(rows)
    out = {}
    for name in names:
        growth, with_x = MODELS[name]
        d = dz.Design(freq, growth)
        coef, coefx = f"_coef_{name}", f"_coefx_{name}"
        rows = _coefficients(rows, d, h, False, coef)
        if with_x:
            rows = _coefficients(rows, d, h, True, coefx)
        ready = F.col(coefx if with_x else coef).isNotNull() & (F.size("hist") >= MIN_BUCKETS)
        out[name] = F.when(ready, _fold(d, h, F.col(coef), F.col(coefx) if with_x else None))
    return rows, out
