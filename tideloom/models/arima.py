"""Seasonal ARIMA with optional regressors, for all series of a batch at once.

Series arrive as arrays on the (id, dsr) row (values or growth, prepared by Spark). A batch is one matrix, a series per row, all of
them ending in the last column with zeros before their start. (1) Unit-root tests say how often a series is differenced.
(2) The residuals of a long autoregression stand for the errors; the cross products of all lags of both are one tensor, and an order
is a sub-block of it. (3) Orders are searched in steps; the orders that a step asks for are solved as one stack each. (4) The
multiplied seasonal polynomials of the order found are fitted by least squares of their errors, unstable ones
are made stable by reflecting partial autocorrelations; the order loses terms for as long as that lowers its AICc.

There is no loop over series: loops run over lags, orders, time and iterations.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.calendar import season_length
from . import design as dz

# Model name -> (growth, external series, automatic order, differences if fixed).
MODELS = {
    "arima01": (False, False, False, 1),
    "arima02": (True, False, False, 0),
    "arimax01": (False, True, False, 1),
    "arimax02": (True, True, False, 1),
    "autoarima01": (False, False, True, None),
    "autoarima02": (True, False, True, None),
    "autoarimax01": (False, True, True, None),
    "autoarimax02": (True, True, True, None),
}
ORDER = (4, 4)
# Highest automatic order by frequency, and shortest series by (external, automatic).
MAX_ORDER = {"d": 10, "m": 12, "q": 4, "y": 3}
MIN_LENGTH = {(False, False): 3, (True, False): 3, (False, True): 5, (True, True): 3}

LEVEL = 0.463  # of the KPSS statistic at five per cent
STRONG = 0.64  # strength of a season from which it is differenced
STABLE = 0.999  # largest partial autocorrelation
ROUNDS = 12  # of least squares with damping, at most
SETTLED = 1e-6  # a series settles when a round lowers its squares by no more than this share
CELLS = 4_000_000  # numbers of a tensor of lags that a task holds
SLOPES = 500_000  # numbers of the slopes of the series that are fitted together
NEAR = 32_768  # numbers that are worked on at once, so that they stay in a core's cache
FEWER = [(-1, 0, 0, 0), (0, -1, 0, 0), (-1, -1, 0, 0), (0, 0, -1, 0), (0, 0, 0, -1)]
STEPS = [(a, b, 0, 0) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b] + [(0, 0, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


@dataclass(frozen=True)
class Search:
    """Highest order, and the length of a season (1: none)."""

    top: int
    season: int


def packed(series: list) -> tuple[np.ndarray, np.ndarray]:
    """The series as rows of a matrix that end in its last column, and their lengths."""
    n = np.fromiter(map(len, series), np.int64, len(series))
    out = np.zeros((len(series), max(1, n.max(initial=1))))
    if n.sum():
        out[valid(out, n)] = np.concatenate(series)
    return out, n


def valid(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(m.shape[1]) >= m.shape[1] - n[:, None]


def back(m: np.ndarray, k: int) -> np.ndarray:
    """Every row ``k`` places later, zeros in front."""
    out = np.zeros_like(m)
    if k < m.shape[-1]:
        out[..., k:] = m[..., : m.shape[-1] - k]
    return out


def difference(m: np.ndarray, n: np.ndarray, times: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows differenced ``times`` over, and what is left of their lengths."""
    for r in range(int(times.max(initial=0))):
        on = times > r
        n = np.where(on, np.maximum(n - lag, 0), n)
        m = np.where(on[:, None], m - back(m, lag), m) * valid(m, n)
    return m, n


def centred(m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = m.sum(axis=1) / np.maximum(n, 1)
    return (m - mean[:, None]) * valid(m, n), mean


def kpss(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The statistic of the test that a series is stationary about a level; 0 for a constant one."""
    e, _ = centred(m, n)
    lags = np.floor(4 * (np.maximum(n, 1) / 100) ** 0.25)
    spread = (e**2).sum(axis=1)
    for j in range(1, int(lags.max(initial=0)) + 1):
        spread += 2 * np.maximum(1 - j / (lags + 1), 0) * (e * back(e, j)).sum(axis=1)
    sums = (np.cumsum(e, axis=1) ** 2 * valid(m, n)).sum(axis=1)
    flat = spread <= 1e-12 * np.maximum((m**2).sum(axis=1), 1e-300)
    return np.where(flat, 0.0, sums / np.where(flat, 1.0, np.maximum(n, 1) * spread))


def season_strength(m: np.ndarray, n: np.ndarray, season: int) -> np.ndarray:
    """1 less the share of variance that seasonal means leave of a series without its moving average; 0 below three seasons,
    where a place in the season is seen only once."""
    half, width = season // 2, season + 1 - season % 2
    weight = np.ones(width)
    weight[[0, -1]] = 1.0 if season % 2 else 0.5
    sums = np.concatenate((np.zeros((len(m), 1)), np.cumsum(m, axis=1)), axis=1)
    inner = m.shape[1] - 2 * half
    if inner <= 0:
        return np.zeros(len(m))
    trend = (sums[:, width : width + inner] - sums[:, :inner]) - (0 if season % 2 else (m[:, :inner] + m[:, 2 * half :]) / 2)
    seen = valid(m[:, half : half + inner], np.maximum(n - 2 * half, 0))
    rest = (m[:, half : half + inner] - trend / season) * seen
    pad = -inner % season
    folded = lambda a: np.pad(a, ((0, 0), (pad, 0))).reshape(len(m), -1, season)
    count = folded(seen.astype(float)).sum(axis=1)
    mean = folded(rest).sum(axis=1) / np.maximum(count, 1)
    left = (folded(rest) - mean[:, None, :]) * folded(seen.astype(float))
    total, _ = centred(rest, seen.sum(axis=1))
    total, left = (total**2).sum(axis=1), (left**2).sum(axis=(1, 2))
    return np.where((n >= 3 * season) & (total > 0), 1 - left / np.where(total > 0, total, 1), 0.0)


def long_errors(w: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Errors of an autoregression whose order, up to ten times the decimal logarithm of the length, has the least AIC."""
    most = np.minimum(n - 1, np.floor(10 * np.log10(np.maximum(n, 1)))).astype(int)
    top = int(most.max(initial=0))
    gamma = np.stack([(w * back(w, k)).sum(axis=1) for k in range(top + 1)], axis=1)
    coef, best = np.zeros((len(w), top)), np.zeros((len(w), top))
    left = np.maximum(gamma[:, 0], 1e-300)
    floor = 1e-12 * left
    least = n * np.log(left)
    for k in range(1, top + 1):
        r = (gamma[:, k] - (coef[:, : k - 1] * gamma[:, k - 1 : 0 : -1]).sum(axis=1)) / left
        coef[:, : k - 1] -= r[:, None] * coef[:, : k - 1][:, ::-1].copy()
        coef[:, k - 1] = r
        left = np.maximum(left * (1 - r**2), floor)
        aic = n * np.log(left) + 2 * k
        better = (aic < least) & (k <= most)
        least, best = np.where(better, aic, least), np.where(better[:, None], coef, best)
    for k in range(top):
        w_k = best[:, k, None] * back(w, k + 1)
        e = w - w_k if k == 0 else e - w_k
    return (e if top else w.copy()) * valid(w, n)


def lag_products(w: np.ndarray, e: np.ndarray, lags: list[int]) -> np.ndarray:
    """Sums of products of the series itself, its ``lags``, and those of its errors: one matrix for each series."""
    def of(w, e):
        z = np.stack([w, *(back(w, k) for k in lags), *(back(e, k) for k in lags)], axis=1)
        return z @ z.transpose(0, 2, 1)

    count = -(-w.size * (2 * len(lags) + 1) // CELLS) or 1
    return np.concatenate([of(*x) for x in zip(np.array_split(w, count), np.array_split(e, count), strict=True)])


def block(order: tuple, lags: list[int]) -> list[int]:
    """The places of an order's regressors in lag_products()."""
    p, q, sp, sq = order
    at = {k: i + 1 for i, k in enumerate(lags)}
    last = lags[-1]
    return [at[k] for k in range(1, p + 1)] + [at[last]] * sp + [len(lags) + at[k] for k in range(1, q + 1)] + [len(lags) + at[last]] * sq


def solved(products: np.ndarray, order: tuple, lags: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of an order for a stack of series, and the squares they leave; of the least norm where several do."""
    at = block(order, lags)
    if not at:
        return np.zeros((len(products), 0)), products[:, 0, 0]
    right = products[:, at, 0]
    coef = (np.linalg.pinv(products[:, at][:, :, at], hermitian=True) @ right[:, :, None])[:, :, 0]
    return coef, np.maximum(products[:, 0, 0] - (coef * right).sum(axis=1), 1e-12 * products[:, 0, 0])


def aicc(squares: np.ndarray, n: np.ndarray, terms: int) -> np.ndarray:
    """Infinite where a series is too short for so many terms."""
    k = terms + 1
    room = n - k - 1
    return np.where(room > 0, n * np.log(np.maximum(squares, 1e-300) / np.maximum(n, 1)) + 2 * k + 2 * k * (k + 1) / np.maximum(room, 1), np.inf)


def asked(orders: np.ndarray, ask: np.ndarray) -> list[tuple[tuple, tuple[np.ndarray, np.ndarray]]]:
    """The different orders among ``orders`` (series, place, term) where asked, none of them negative, and the (series, place) of each."""
    at = np.nonzero(ask)
    found = orders[at]
    base = int(found.max(initial=0)) + 1
    code = found @ base ** np.arange(3, -1, -1)
    by_code = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[by_code])) + 1
    parts = np.split(by_code, cuts) if len(code) else []
    return [(tuple(found[x[0]].tolist()), (at[0][x], at[1][x])) for x in parts]


def searched(products: np.ndarray, n: np.ndarray, lags: list[int], search: Search, seasonal: np.ndarray) -> np.ndarray:
    """The order (p, q, P, Q) of every series: from the best of four, in steps to the best neighbour until none has a lower AICc.

    Orders for which a series is too short have no AICc and are never chosen. ``seasonal``: series that may have P and Q.
    """
    season, known = search.season, {}

    def allowed(o, rows):
        inside = (o >= 0).all(axis=2) & (o[:, :, :2] <= search.top).all(axis=2) & (o[:, :, 2:] <= 1).all(axis=2)
        return inside & ((o[:, :, 2:] == 0).all(axis=2) | (seasonal[rows, None] & (o[:, :, :2] < season).all(axis=2)))

    def scores(orders, rows):
        """AICc of several orders for each series in ``rows``. An order is solved once for all series that ask for it."""
        out = np.full(orders.shape[:2], np.inf)
        for o, (at, place) in asked(orders, allowed(orders, rows)):
            score, mine = known.setdefault(o, np.full(len(n), np.nan)), rows[at]
            new = mine[np.isnan(score[mine])]
            if len(new):
                left = solved(products[new], o, lags)[1]
                score[new] = aicc(left, n[new], sum(o))
            out[at, place] = score[mine]
        return out

    now, every = np.zeros((len(n), 4), np.int64), np.arange(len(n))
    least = scores(now[:, None], every)[:, 0]
    s = seasonal[:, None].astype(np.int64)
    top = min(2, search.top, season - 1) if season > 1 else min(2, search.top)
    for p, q in ((1, 0), (0, 1), (top, top)):
        start = np.concatenate([np.full_like(s, p), np.full_like(s, q), s * (p > 0), s * (q > 0)], axis=1)
        score = scores(start[:, None], every)[:, 0]
        better = score < least
        now, least = np.where(better[:, None], start, now), np.where(better, score, least)
    moving = every
    while len(moving):
        orders = now[moving][:, None] + np.array(STEPS)
        score = scores(orders, moving)
        best = np.where(np.isnan(score), np.inf, score).argmin(axis=1)  # the first of equal ones
        found = score[np.arange(len(moving)), best]
        better = found < least[moving]
        orders, moving = orders[better, best[better]], moving[better]
        now[moving], least[moving] = orders, found[better]
    return now


def polynomials(coef: np.ndarray, order: tuple, season: int) -> tuple[list[tuple[int, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """(lag, coefficients) of the multiplied autoregressive and moving-average polynomials. Terms lie along the last axis of ``coef``."""
    p, q, sp, sq = order
    ar, far, ma, fma = np.split(np.moveaxis(coef, -1, 0), np.cumsum([p, sp, q]))
    out_ar = [(k + 1, ar[k]) for k in range(p)]
    out_ma = [(k + 1, ma[k]) for k in range(q)]
    for f in far:
        out_ar += [(season, f), *((season + k, -f * c) for k, c in out_ar)]
    for f in fma:
        out_ma += [(season, f), *((season + k, f * c) for k, c in out_ma)]
    return out_ar, out_ma


def errors_by_time(w: np.ndarray, coef: np.ndarray, order: tuple, season: int) -> np.ndarray:
    """One-step errors of series that are columns of ``w``, a row per place; values and errors before a series are 0.

    ``coef`` may have several sets of coefficients for every series, along its first axis; so may the result, along its second. With the
    places in front, every step works on neighbouring numbers.
    """
    ar, ma = polynomials(coef, order, season)
    places, most = len(w), max((k for k, _ in ma), default=0)
    out = np.zeros((most + places, *coef.shape[:-1]))
    w = w.reshape(places, *[1] * (coef.ndim - 2), -1)
    e, step = out[most:], max(1, NEAR // max(1, out[0].size))
    e += w
    for at in range(0, places, step):
        for k, c in ar:
            e[max(at, k) : at + step] -= c * w[max(at - k, 0) : max(min(at + step, places) - k, 0)]
    if not ma:
        return e
    c, lags = np.stack([x for _, x in ma]), np.array([k for k, _ in ma])
    in_turn, flipped, product, total = most == len(lags), out[::-1], np.empty_like(c), np.empty_like(c[0])
    for t in range(places):
        past = flipped[places - t : places - t + most] if in_turn else out[most + t - lags]
        np.add.reduce(np.multiply(c, past, out=product), axis=0, out=total)
        e[t] -= total
    return e


def errors_of(w: np.ndarray, coef: np.ndarray, order: tuple, season: int) -> np.ndarray:
    """errors_by_time() of series that are rows."""
    return np.ascontiguousarray(errors_by_time(np.ascontiguousarray(w.T), coef, order, season).T)


def slopes(w: np.ndarray, coef: np.ndarray, e: np.ndarray, order: tuple, season: int) -> np.ndarray:
    """How the errors ``e`` of every series change with each of its coefficients: a matrix (coefficient, place) for each series."""
    k, small = coef.shape[1], 1e-6
    turn = errors_by_time(np.ascontiguousarray(w.T), coef + np.eye(k)[:, None] * small, order, season)
    turn -= e.T[:, None]
    turn /= small
    out = np.ascontiguousarray(turn.transpose(2, 1, 0))
    if not (out.size and np.abs(out).max() <= 1e100):  # or one isn't a number
        out = np.clip(np.nan_to_num(out, posinf=0, neginf=0), -1e100, 1e100)
    return out


def reflected(coef: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients with every partial autocorrelation outside the unit circle turned into its inverse."""
    p = coef.shape[1]
    if not p:
        return coef
    down, partial = coef.copy(), np.zeros_like(coef)
    for k in range(p, 0, -1):
        r = down[:, k - 1]
        r = np.where(np.abs(np.abs(r) - 1) < 1e-9, np.sign(r) * STABLE, r)
        partial[:, k - 1] = r
        down[:, : k - 1] = (down[:, : k - 1] + r[:, None] * down[:, : k - 1][:, ::-1]) / (1 - r**2)[:, None]
    inside = np.where(np.abs(partial) > 1, 1 / np.where(partial == 0, 1, partial), partial)
    inside = np.clip(np.nan_to_num(inside), -STABLE, STABLE)
    up = np.zeros_like(coef)
    for k in range(1, p + 1):
        r = inside[:, k - 1]
        up[:, : k - 1] -= r[:, None] * up[:, : k - 1][:, ::-1].copy()
        up[:, k - 1] = r
    return np.where((inside == partial).all(axis=1)[:, None], coef, up)


def stable(coef: np.ndarray, order: tuple) -> np.ndarray:
    ar, far, ma, fma = np.split(coef, np.cumsum(order[0:1] + order[2:3] + order[1:2]), axis=1)
    return np.concatenate([reflected(ar), reflected(far), -reflected(-ma), -reflected(-fma)], axis=1)


def fitted(w: np.ndarray, coef: np.ndarray, order: tuple, season: int) -> np.ndarray:
    """Coefficients that minimise the squared errors: damped least squares from ``coef``, all series in step.

    Orders without moving average and season are a regression, so they are minimal already.
    """
    coef = stable(coef, order)
    if not (order[1] or order[2] or order[3]):
        return coef
    k = coef.shape[1]
    loss = lambda e: np.nan_to_num((e**2).sum(axis=1), nan=np.inf)
    e = errors_of(w, coef, order, season)
    least, damp, live = loss(e), np.full(len(w), 1e-3), np.arange(len(w))
    for _ in range(ROUNDS):
        # every series goes on by itself until it has settled, so its fit doesn't depend on the others in the batch
        own, at, now = w[live], coef[live], e[live]
        slope = slopes(own, at, now, order, season)
        grad, bend = slope @ now[:, :, None], slope @ slope.transpose(0, 2, 1)
        size = np.einsum("bkk->bk", bend)
        bend = bend + np.eye(k) * (damp[live, None] * (size + 1e-9 * size.max(axis=1, keepdims=True)))[:, None, :]
        new = stable(at - (np.linalg.pinv(bend, hermitian=True) @ grad)[:, :, 0], order)
        new_e = errors_of(own, new, order, season)
        new_loss, old = loss(new_e), least[live]
        better = new_loss < old
        coef[live], e[live], least[live] = np.where(better[:, None], new, at), np.where(better[:, None], new_e, now), np.where(better, new_loss, old)
        damp[live] = np.clip(np.where(better, damp[live] / 4, damp[live] * 8), 1e-9, 1e6)
        live = live[np.where(better, old - new_loss > SETTLED * old, damp[live] < 1e3)]
        if not len(live):
            break
    return coef


def continued(w: np.ndarray, e: np.ndarray, coef: np.ndarray, order: tuple, season: int, h: int) -> np.ndarray:
    """The ``h`` values after each series; errors to come are 0."""
    ar, ma = polynomials(coef, order, season)
    most = max([k for k, _ in ar + ma], default=0)
    wide = lambda m: np.concatenate([np.zeros((len(m), most)), m, np.zeros((len(m), h))], axis=1)
    w, e = wide(w), wide(e)
    for t in range(w.shape[1] - h, w.shape[1]):
        for k, c in ar:
            w[:, t] += c * w[:, t - k]
        for k, c in ma:
            w[:, t] += c * e[:, t - k]
    return w[:, w.shape[1] - h :]


def arma(w: np.ndarray, n: np.ndarray, h: int, search: Search | None, order: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of stationary series, and the order (p, q, P, Q) of each: the given one, or the one that ``search`` finds."""
    season = search.season if search else 1
    lags = list(range(1, (search.top if search else max(order)) + 1))
    if search and season > lags[-1]:
        lags.append(season)
    products = lag_products(w, long_errors(w, n), lags)
    if search:
        seasonal = (n > 2 * season) if season > 1 and lags[-1] == season else np.zeros(len(n), bool)
        orders = searched(products, n, lags, search, seasonal)
    else:
        orders = np.tile(np.array([*order, 0, 0]), (len(n), 1))
    known: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def fit(order, rows):
        """Fits an order to those of ``rows`` that it isn't fitted to yet."""
        score, coef = known.setdefault(order, (np.full(len(n), np.nan), np.zeros((len(n), sum(order)))))
        new = rows[np.isnan(score[rows])]
        # slopes are held for every coefficient
        for part in np.array_split(new, -(-len(new) * max(1, sum(order)) * w.shape[1] // SLOPES)) if len(new) else ():
            coef[part] = fitted(w[part], solved(products[part], order, lags)[0], order, season)
            squares = (errors_of(w[part], coef[part], order, season) ** 2).sum(axis=1)
            score[part] = aicc(np.maximum(np.nan_to_num(squares, nan=np.inf), 1e-12 * products[part, 0, 0]), n[part], sum(order))
        return score

    moving = np.arange(len(n)) if search else np.zeros(0, np.int64)
    while len(moving):
        fewer = orders[moving][:, None] + np.array([(0, 0, 0, 0), *FEWER])
        score = np.full(fewer.shape[:2], np.inf)
        for o, (at, place) in asked(fewer, (fewer >= 0).all(axis=2)):  # an order is fitted once to all series that ask for it
            score[at, place] = fit(o, moving[at])[moving[at]]
        best = np.where(np.isnan(score), np.inf, score).argmin(axis=1)  # the first of equal ones
        orders[moving] = fewer[np.arange(len(moving)), best]
        moving = moving[best > 0]
    out = np.zeros((len(w), h))
    for o, (rows, _) in asked(orders[:, None], np.ones((len(n), 1), bool)):
        fit(o, rows)
        coef = known[o][1][rows]
        out[rows] = continued(w[rows], errors_of(w[rows], coef, o, season), coef, o, season, h)
    return out, orders


def differences(y: np.ndarray, n: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray]:
    """How often to difference: by season (0 or 1, by its strength) and plainly (0 to 2, while the test refuses a level)."""
    by_season = (season_strength(y, n, season) > STRONG).astype(int) if season > 1 else np.zeros(len(n), int)
    w, m = difference(y, n, by_season, season)
    plainly = np.zeros(len(n), int)
    for _ in range(2):
        more = (kpss(w, m) > LEVEL) & (m > 3)
        if not more.any():
            break
        plainly += more
        w, m = difference(w, m, more.astype(int), 1)
    return plainly, by_season


def batch(y: np.ndarray, n: np.ndarray, x: np.ndarray | None, h: int, d: int | None, search: Search | None, order: tuple = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of all rows of ``y``, and (p, d, q, P, D, Q) of each. ``x`` has regressors by row, series and place, ``h`` places beyond."""
    season = search.season if search else 1
    if d is None:
        plainly, by_season = differences(y, n, season)
    else:
        plainly, by_season = np.minimum(d, np.maximum(n - 2, 0)), np.zeros(len(n), int)
    v, m = difference(y, n, by_season, season)
    w, m = difference(v, m, plainly, 1)
    mean = np.zeros(len(n))
    if search:  # a level, or the slope of a series differenced once
        u, mean = centred(w, m)
        twice = plainly + by_season > 1
        w, mean = np.where(twice[:, None], w, u), np.where(twice, 0.0, mean)
    base = np.zeros((len(n), h))
    if x is not None and x.shape[1]:
        rows, series, places = x.shape
        again = lambda a: np.repeat(a, series)
        flat, length = difference(x.reshape(-1, places), again(n + h), again(by_season), season)
        flat, _ = difference(flat, length, again(plainly), 1)
        flat = flat.reshape(rows, series, places)
        z = flat[:, :, : places - h] * valid(w, m)[:, None, :]
        beta = np.linalg.pinv(z @ z.transpose(0, 2, 1), hermitian=True) @ (z @ w[:, :, None])
        w = w - (beta.transpose(0, 2, 1) @ z)[:, 0]
        base = (beta.transpose(0, 2, 1) @ flat[:, :, places - h :])[:, 0]
    out, orders = arma(w, m, h, search, order)
    out += base + mean[:, None]
    for r in range(int(plainly.max(initial=0)), 0, -1):
        before, _ = difference(v, n, np.minimum(plainly, r - 1), 1)
        out = np.where((plainly >= r)[:, None], before[:, -1:] + np.cumsum(out, axis=1), out)
    if by_season.any():
        ends = np.concatenate([np.zeros((len(n), max(0, season - y.shape[1]))), y], axis=1)[:, -season:]
        for t in range(h):
            out[:, t] += by_season * (ends[:, t] if t < season else out[:, t - season])
    return out, np.stack([orders[:, 0], plainly, orders[:, 1], orders[:, 2], by_season, orders[:, 3]], axis=1)


def forecasts(series: list, xs: list | None, h: int, d: int | None, search: Search | None, need: int, order: tuple = ORDER) -> list:
    """A forecast for each series, None where it is shorter than ``need``, or its values or forecast aren't finite.

    With ``xs``, the external series of each, the model has them for as long as all are known, and goes on without them.
    """
    out = np.full((len(series), h), np.nan)
    series = [np.asarray(s, dtype=float) for s in series]
    fit = np.flatnonzero([len(s) >= need and bool(np.isfinite(s).all()) for s in series])
    longest = max((len(series[i]) for i in fit), default=1)
    cells = (3 + 2 * (search.top if search else max(order))) ** 2 + 10 * longest  # products of lags, and what is held beside them
    for part in np.array_split(fit, max(1, -(-len(fit) * cells // (4 * CELLS)))):
        if not len(part):
            continue
        with np.errstate(all="ignore"):
            y, n = packed([series[i] for i in part])
            scale = np.abs(y).max(axis=1)
            scale = np.where(scale > 0, scale, 1.0)  # so that no sum of squares overflows
            y = y / scale[:, None]
            plain, _ = batch(y, n, None, h, d, search, order)
            if xs is not None:
                count = np.array([len(xs[i]) for i in part])
                x = np.zeros((len(part), count.max(initial=0), y.shape[1] + h))
                if count.any():
                    flat, size = packed([np.asarray(v, dtype=float) for v in chain.from_iterable(xs[i] for i in part)])
                    row = np.repeat(np.arange(len(part)), count)
                    slot = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                    x[row, slot, x.shape[2] - flat.shape[1] :] = flat
                gone = np.cumsum(np.isnan(x[:, :, x.shape[2] - h :]).any(axis=1), axis=1) > 0
                x = np.nan_to_num(x)
                x /= np.maximum(np.abs(x).max(axis=2, keepdims=True, initial=0), 1e-300)
                with_x, _ = batch(y, n, x, h, d, search, order)
                plain = np.where(gone, plain, with_x)
            out[part] = plain * scale[:, None]
    return [f if np.isfinite(f).all() else None for f in out]


def expression(name: str, freq: str, h: int, order: tuple[int, int] | None = None) -> Column:
    """Forecast array of one ARIMA model, NULL where the series is too short. ``order`` replaces the order of the fixed models."""
    growth, with_x, automatic, d = MODELS[name]
    season = season_length(freq)
    search = Search(MAX_ORDER[freq], season) if automatic else None
    need, order = MIN_LENGTH[(with_x, automatic)], tuple(order or ORDER)
    hist, b0 = F.col("hist"), F.col("b0")
    y = dz.growth_values(hist, b0, freq) if growth else hist

    if with_x:

        @F.pandas_udf("array<double>")
        def solve(y: pd.Series, xs: pd.Series) -> pd.Series:
            return pd.Series(forecasts(y.tolist(), xs.tolist(), h, d, search, need, order), dtype=object)

        # the last places of each external series: those of y and the horizon
        length = F.size(y) + h
        f = solve(y, F.transform("xs", lambda x: F.slice(x, F.size(x) - length + 1, length)))
    else:

        @F.pandas_udf("array<double>")
        def solve_plain(y: pd.Series) -> pd.Series:
            return pd.Series(forecasts(y.tolist(), None, h, d, search, need, order), dtype=object)

        f = solve_plain(y)
    return dz.from_growth_values(f, hist, b0, freq) if growth else f
