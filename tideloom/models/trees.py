"""Tree ensembles pooled over all series, one model per forecast origin.

Every origin trains on what was known at it, so the origins of a back-test are separate
MLlib fits; within a fit rows of all series are distributed. The target and the lags are
divided by the mean level of their series, which makes series comparable. The fitted trees become
small arrays, and all steps of the recursion of all origins run in one pass over the histories.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions import calendar as cal
from ..functions import series as sa
from ..session import cut_lineage
from . import design as dz

# Model name -> (kind, growth target, external series).
MODELS = {
    "randomforest01": ("forest", False, False),
    "randomforest02": ("forest", True, False),
    "randomforestx01": ("forest", False, True),
    "randomforestx02": ("forest", True, True),
    "xgboost01": ("boost", False, False),
    "xgboost02": ("boost", True, False),
    "xgboostx01": ("boost", False, True),
    "xgboostx02": ("boost", True, True),
}
# Options of a request. ``series_per_task`` decides how training rows are dealt: bootstrap samples follow the
# partitions, so their number comes from the data and this option alone, never from the session. ``x_columns`` are the features
# that external series are hashed to. ``at_once`` fits are submitted together: a fit is a chain of short jobs.
DEFAULTS = {"trees": 20, "rounds": 20, "depth": 5, "step": 0.1, "series_per_task": 500, "x_columns": 16, "at_once": 4}
ROWS = 1000  # histories that are walked at once


def _regressor(kind: str, opt: dict):
    common = {"featuresCol": "features", "labelCol": "label", "seed": 1}
    if kind == "forest":
        return RandomForestRegressor(numTrees=opt["trees"], maxDepth=opt["depth"], **common)
    return GBTRegressor(maxIter=opt["rounds"], maxDepth=opt["depth"], stepSize=opt["step"], **common)


def _x_columns(rows: DataFrame, h: int, columns: int) -> DataFrame:
    """``x_cols``: ``columns`` arrays on the positions of ``hist`` and ``h`` beyond: the external series by a hash of their id.

    Every series is relative to its own level, and has the same column in all targets. Series of one target that meet in a column
    are added up; an unknown value makes the position of its column NULL. A column without a series is zero.
    """
    level = lambda x: sa.array_mean(F.filter(x, lambda v: v.isNotNull()))
    value = lambda m, t: F.try_divide(sa.at(m["x"], t), m["level"])
    # series and level are bound by a lambda, so that they are computed once for all positions
    meet = lambda c: F.filter("xs", lambda _, i: F.pmod(F.xxhash64(F.get("x_ids", i)), F.lit(columns)) == c)
    members = F.transform(
        F.array(*map(F.lit, range(columns))), lambda c: F.transform(meet(c), lambda x: F.struct(x.alias("x"), level(x).alias("level")))
    )
    positions = F.sequence(F.lit(0), F.size("hist") + h - 1)

    def column(mine: Column) -> Column:
        total = lambda t: F.aggregate(mine, sa.zero(), lambda acc, m: acc + F.coalesce(value(m, t), sa.zero()))
        return F.transform(positions, lambda t: F.when(~F.exists(mine, lambda m: value(m, t).isNull()), total(t)))

    return rows.withColumn("x_cols", F.transform(members, column)).drop("xs", "x_ids")


def _features(d: dz.Design, hist: Column, t: Column, with_x: bool) -> Column:
    b0, scale = F.col("b0"), F.col("scale")
    numeric = d.numeric(hist, t, b0, F.col("seas"))
    free = {0, 1} if d.growth else {2}  # growth and momentum have no unit
    level = [v if j in free else v / scale for j, v in enumerate(numeric)]
    if d.freq == "y":
        level[0] = numeric[0] if d.growth else numeric[0] / scale
        level[1:] = [v / scale for v in numeric[1:]]
    codes = [c.cast("double") for c in dz.codes(b0 + t, d.freq)]
    own = F.array(*codes, *level)
    return F.concat(own, F.transform("x_cols", lambda x: sa.at(x, t))) if with_x else own


def _train(rows: DataFrame, d: dz.Design, with_x: bool, kind: str, opt: dict):
    hist, b0 = F.col("hist"), F.col("b0")
    label = lambda t: d.target(hist, t, b0) / (F.lit(1.0) if d.growth else F.col("scale"))
    cells = F.transform(
        d.positions(hist), lambda t: F.struct(_features(d, hist, t, with_x).alias("f"), label(t).alias("label"))
    )
    # fixed partitions and row order, so that a fit repeats on any cluster
    parts = max(1, -(-rows.count() // opt["series_per_task"]))
    placed = rows.repartition(parts, "id").sortWithinPartitions("id")
    data = (
        placed.select(F.explode(cells).alias("c"))
        .filter(F.col("c.label").isNotNull() & ~F.exists("c.f", lambda v: v.isNull()))
        .select(array_to_vector("c.f").alias("features"), F.col("c.label").alias("label"))
    )
    return None if data.isEmpty() else _regressor(kind, opt).fit(data)


@dataclass(frozen=True)
class Trees:
    """The trees of one fit as arrays (tree, node): their size follows from the options, not from the data."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # (tree, node, right)
    value: np.ndarray
    weights: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """One prediction per row; in each round every row takes a step in every tree."""
        tree, row = np.arange(len(self.weights))[:, None], np.arange(len(x))[None, :]
        node = np.zeros((len(self.weights), len(x)), dtype=np.intp)
        for _ in range(self.depth):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = self.child[tree, node, right.astype(np.intp)]
        return self.weights @ self.value[tree, node]


def exported(model, kind: str) -> Trees:
    """The nodes of a fitted MLlib model in level order; a leaf is its own child."""
    grown = []
    for t in model.trees:
        queue, cells = [t._call_java("rootNode")], []
        while len(cells) < len(queue):
            n, at = queue[len(cells)], len(cells)
            if n.subtreeDepth() == 0:
                cells.append((0, 0.0, at, at, n.prediction()))
            else:
                cells.append((n.split().featureIndex(), n.split().threshold(), len(queue), len(queue) + 1, n.prediction()))
                queue += [n.leftChild(), n.rightChild()]
        grown.append(cells)
    table = np.zeros((len(grown), max(map(len, grown)), 5))
    for t, cells in enumerate(grown):
        table[t, : len(cells)] = cells
    weights = np.asarray(model.treeWeights, dtype=float)
    weights = weights / weights.sum() if kind == "forest" else weights
    whole = table[:, :, [0, 2, 3]].astype(np.intp)
    return Trees(whole[:, :, 0], table[:, :, 1], whole[:, :, 1:], table[:, :, 4], weights, max(t.depth for t in model.trees))


def _growth(value: np.ndarray, base: np.ndarray) -> np.ndarray:
    """operators.growth.growth_rate on arrays, NaN for NULL."""
    missing, zero = np.isnan(value) | np.isnan(base), base == 0
    rate = (value - base) / np.where(zero | missing, 1.0, base)
    return np.where(missing, 1.0, np.where(~zero, rate, np.where(value < 0, -1.0, 1.0)))


@dataclass(frozen=True)
class Walk:
    """The recursion of a batch of histories of one origin.

    Histories are laid side by side so that they all end at the same column: a lag is then one column for all of them.
    What depends on the calendar alone comes from Spark for all ``h`` steps.
    """

    d: dz.Design
    h: int
    plain: Trees
    rich: Trees | None

    def _numeric(self, past: np.ndarray, at: int, length: np.ndarray, step: dict[str, np.ndarray], scale: np.ndarray) -> np.ndarray:
        """Design.numeric, scaled as in _features; ``at`` is the column of the value to predict."""
        p, yearly, row = cal.season_length(self.d.freq), self.d.freq == "y", np.arange(len(past))
        if self.d.growth:
            rate = lambda k, back: _growth(past[:, at - k], past[row, at - k - back])
            lags = [rate(1, step["back_1"])] + ([] if yearly else [rate(p, step["back_p"])])
        else:
            lags = [past[:, at - 1] / scale]
            if not yearly:
                recent, base = past[:, at - p], past[:, at - p - 1]
                momentum = np.where((length < 12) & (base == 0), 0.0, _growth(recent, base))
                lags += [recent / scale, momentum]
        s = at - dz.DEC_LAG
        trend = (past[:, s - 2] + 2 * (past[:, s - 1] + past[:, s] + past[:, s + 1]) + past[:, s + 2]) / 8
        rest = past[:, s] - trend - step["seas_back"]
        return np.stack([*lags, trend / scale, step["seas"] / scale, rest / scale], axis=1)

    def forecast(self, hist: list[np.ndarray], scale: np.ndarray, steps: dict[str, np.ndarray], codes: np.ndarray, x: np.ndarray | None) -> np.ndarray:
        """(rows, h): arrays of ``steps`` are (rows, h), ``codes`` and ``x`` (rows, h, features), NaN for NULL."""
        length = np.array([len(v) for v in hist])
        end = int(length.max())
        past = np.full((len(hist), end + self.h), np.nan)
        for i, v in enumerate(hist):
            past[i, end - len(v) : end] = v
        off = np.zeros(len(hist), dtype=bool)
        row = np.arange(len(hist))
        for k in range(self.h):
            now = {name: v[:, k] for name, v in steps.items()}
            own = np.concatenate([codes[:, k], self._numeric(past, end + k, length + k, now, scale)], axis=1)
            own = np.where(np.isnan(own), 0.0, own)
            value = self.plain.predict(own)
            if self.rich is not None:
                off |= np.isnan(x[:, k]).any(axis=1)
                beside = np.where(np.isnan(x[:, k]), 0.0, x[:, k])
                value = np.where(off, value, self.rich.predict(np.concatenate([own, beside], axis=1)))
            if self.d.growth:
                back = now["anchor"]
                base = past[row, end + k - np.where(np.isnan(back), 1, back).astype(int)]
                value = np.where(np.isnan(back), np.nan, (1 + value) * base)
            else:
                value = value * scale
            past[:, end + k] = value
        # a history with a value that isn't finite has no forecast
        bad = ~np.isfinite(np.where(np.arange(end + self.h) < end - length[:, None], 0.0, past)).all(axis=1)
        past[bad] = np.nan
        return past[:, end:]


def _walk_input(rows: DataFrame, d: dz.Design, h: int, with_x: bool) -> DataFrame:
    """Histories with what the steps need from the calendar, as flat arrays."""
    n, b0 = F.size("hist"), F.col("b0")
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(h - 1)), f)
    number = lambda c: c.cast("double")
    p = cal.season_length(d.freq)
    out = {
        "back_1": each(lambda k: dz.year_back(b0 + n + k - 1, d.freq)),
        "back_p": each(lambda k: dz.year_back(b0 + n + k - p, d.freq)),
        "anchor": each(lambda k: number(dz.anchor_back(b0 + n + k, d.freq))),
        "seas_now": each(lambda k: sa.at(F.col("seas"), (n + k) % 4)),
        "seas_back": each(lambda k: sa.at(F.col("seas"), (n + k - dz.DEC_LAG) % 4)),
        "codes": F.flatten(each(lambda k: F.array(*[number(c) for c in dz.codes(b0 + n + k, d.freq)]).cast("array<double>"))),
        "x": F.flatten(each(lambda k: F.transform("x_cols", lambda x: sa.at(x, n + k)))) if with_x else F.array().cast("array<double>"),
    }
    return rows.select("id", "dsr", "s0", "hist", "scale", *[c.alias(k) for k, c in out.items()])


def _walked(rows: DataFrame, d: dz.Design, h: int, fits: dict[dt.date, tuple[Trees, Trees | None]], with_x: bool) -> DataFrame:
    """Rows ``id, dsr, s0, f`` of the histories whose origin has a fit."""

    def matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
        flat = b.column(name).flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(b.num_rows, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                b = whole.slice(first, ROWS)
                dsr, out = np.array(b.column("dsr").to_pylist(), dtype=object), np.full((b.num_rows, h), np.nan)
                hist = [np.asarray(v, dtype=float) for v in b.column("hist").to_pylist()]
                scale = b.column("scale").to_numpy(zero_copy_only=False)
                steps = {k: matrix(b, v) for k, v in (("back_1", "back_1"), ("back_p", "back_p"), ("anchor", "anchor"), ("seas", "seas_now"), ("seas_back", "seas_back"))}
                codes, x = matrix(b, "codes").reshape(b.num_rows, h, -1), matrix(b, "x").reshape(b.num_rows, h, -1) if with_x else None
                for origin in sorted(set(dsr)):
                    mine = np.flatnonzero(dsr == origin)
                    walk = Walk(d, h, *fits[origin])
                    out[mine] = walk.forecast([hist[i] for i in mine], scale[mine], {k: v[mine] for k, v in steps.items()}, codes[mine], x[mine] if with_x else None)
                f = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, h), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*map(b.column, ("id", "dsr", "s0")), f], ["id", "dsr", "s0", "f"])

    own = _walk_input(rows.filter(F.col("dsr").isin(*fits)), d, h, with_x)
    kinds = dict(rows.dtypes)
    return own.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("id", "dsr", "s0")) + ", f array<double>")


def prepared(rows: DataFrame, freq: str, h: int, options: dict) -> DataFrame:
    """Histories with the columns that all tree models share, written once for all of them."""
    level = sa.array_mean(F.transform("hist", F.abs))
    long = rows.filter(F.size("hist") >= 8).withColumn("scale", F.when(level > 0, level).otherwise(1.0))
    if "xs" in rows.columns:
        long = _x_columns(long, h, {**DEFAULTS, **options}["x_columns"])
    return cut_lineage(dz.with_seasonal_means(long))


def forecasts(
    rows: DataFrame, origins: Sequence[dt.date], name: str, freq: str, h: int, options: dict
) -> DataFrame | None:
    """Rows ``id, dsr, s0, f`` of one tree model from prepared() rows, or None without any training row."""
    kind, growth, with_x = MODELS[name]
    d = dz.Design(freq, growth)
    opt = {**DEFAULTS, **options}
    rows = rows.filter(F.size("hist") - d.first > 1)

    def fit(origin: dt.date):
        known = rows.filter(F.col("dsr") == F.lit(origin))
        plain = _train(known, d, False, kind, opt)
        rich = _train(known, d, True, kind, opt) if with_x and plain is not None else None
        if plain is None or (with_x and rich is None):
            return None
        return exported(plain, kind), exported(rich, kind) if with_x else None

    with ThreadPool(min(opt["at_once"], len(origins))) as pool:
        found = pool.map(inheritable_thread_target(rows.sparkSession)(fit), origins)
    fits = {origin: f for origin, f in zip(origins, found, strict=True) if f is not None}
    return _walked(rows, d, h, fits, with_x) if fits else None
