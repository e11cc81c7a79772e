"""Quality classifier: kernel ridge by random Fourier features of document statistics, calibrated.

The cosine features of D random directions approximate a Gaussian kernel over the standardized
statistics. Each partition sums its own part of the normal equations; only these sums, of a size fixed by D,
meet. An isotonic fit on learning rows that the ridge hasn't seen turns its scores into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, written

THRESHOLD = 0.3  # from this score on a document is taken as good
DIRECTIONS = 192
RIDGE = 1e-3  # times the number of learning rows
WIDTH = 1.0  # of the kernel, times the root of the number of statistics
SEED = 7
BINS = 2000  # of ridge scores from -0.5 to 1.5, in which the isotonic fit gets its rows
UNKNOWN = 0.5  # the score of all documents where nothing can be learnt
SIGNS = b"!|#$%&*=<>{}\"';:,.?-_()"  # each has a statistic of its own


def _lookup(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[np.frombuffer(chars, np.uint8)] = 1
    return out


UPPER, LOWER, DIGIT = (_lookup(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
BLANK, BEYOND = _lookup(b" \t\n\x0b\x0c\r"), _lookup(bytes(range(128, 256)))
CODES = np.frombuffer(SIGNS, np.uint8)
SIZE = 13 + len(SIGNS)


def statistics(text: str) -> np.ndarray:
    """The statistics of one whole text; all zero for the empty text."""
    out = np.zeros(SIZE)
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return out
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.splitlines()
    n, m, letters = len(raw), max(1, len(words)), max(1.0, seen @ (UPPER + LOWER))
    out[:13] = (
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(n / m),
        seen @ UPPER / letters,
        seen @ DIGIT / n,
        seen @ BLANK / n,
        seen @ BEYOND / n,
        sum(map(eq, words, words[1:])) / m,
        np.log1p(len(set(words))) / np.log1p(m),
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        sum(map(len, set(words))) / n,
        len(max(words, key=len, default=b"")) ** 0.25,
    )
    out[13:] = np.sqrt(seen[CODES] / n)
    return out


@dataclass
class Model:
    """All that scoring needs; its size depends on the parameters alone. Without weights it knows nothing."""

    mean: np.ndarray
    scale: np.ndarray
    turn: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None = None
    bounds: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.cos((x - self.mean) / self.scale @ self.turn + self.shift) * np.sqrt(2 / len(self.shift))

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), UNKNOWN)
        raw = self.raw(x)
        return raw.clip(0, 1) if self.bounds is None else np.interp(raw, self.bounds, self.values).clip(0, 1)


def learning_rows(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Statistics, label (the mean of repeated ones) and fold 1 to 4 of the labelled rows outside fold 0."""

    def run(batches):
        for b in slices(batches):
            stats = np.array([statistics(t) for t in texts(b.column(1))]).reshape(-1, SIZE)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), SIZE).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "stats"])

    known = labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.avg(label).alias("y"))
    known = known.withColumn("fold", fold("doc_id")).filter("fold != 0")
    stats = docs.select("doc_id", "text").filter(fold("doc_id") != 0).mapInArrow(run, "doc_id bigint, stats array<double>")
    return written(stats.join(known, "doc_id").select("stats", "y", "fold"), "learning")


def fold(doc_id: str):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model of P(label = 1) from all labelled rows but those of fold 0. Rows of fold 1 only calibrate."""
    rows = learning_rows(docs, labels, label)
    ridge_rows = rows.filter("fold != 1")
    moments = ridge_rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x"), F.stddev_pop("x")).collect()
    rng = np.random.default_rng(SEED)
    turn = rng.normal(size=(SIZE, DIRECTIONS)) / (WIDTH * np.sqrt(SIZE))
    model = Model(np.zeros(SIZE), np.ones(SIZE), turn, rng.uniform(0, 2 * np.pi, DIRECTIONS))
    if not moments:
        return model
    for i, mean, std in moments:
        model.mean[i], model.scale[i] = mean, std or 1.0
    d = DIRECTIONS + 1

    def normal_equations(batches):
        own = np.zeros((d, d + 1))
        for b in batches:
            x = np.array(b.column("stats").to_pylist()).reshape(-1, SIZE)
            z = np.concatenate([model.features(x), np.ones((len(x), 1))], axis=1)
            own += z.T @ np.concatenate([z, b.column("y").to_numpy()[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(own.size)), pa.array(own.ravel())], ["cell", "part"])

    # one row per cell of a matrix of fixed size, summed by Spark in a fixed order of partitions' exact values
    summed = ridge_rows.mapInArrow(normal_equations, "cell bigint, part double").groupBy("cell").agg(F.sum("part").alias("s"))
    total = np.zeros(d * (d + 1))
    for cell, s in summed.collect():
        total[cell] = s
    total = total.reshape(d, d + 1)
    penalty = RIDGE * total[-1, d - 1] * np.eye(d) / d
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :d] + penalty + 1e-9 * np.eye(d), total[:, d])

    def raw(batches):
        for b in batches:
            x = np.array(b.column("stats").to_pylist()).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((model.raw(x) + 0.5) * (BINS / 2)).astype(np.int64)), b.column("y")], ["bin", "y"])

    binned = rows.filter("fold = 1").mapInArrow(raw, "bin bigint, y double")
    binned = binned.groupBy("bin").agg(F.avg("y").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    binned = binned.withColumn("raw", F.col("bin") / (BINS / 2) - 0.5)
    if binned.take(1):
        assembled = VectorAssembler(inputCols=["raw"], outputCol="features").transform(binned)
        curve = IsotonicRegression(labelCol="label", weightCol="weight").fit(assembled)
        model.bounds, model.values = curve.boundaries.toArray(), curve.predictions.toArray()
    return model


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text; null and empty texts are scored as empty."""
    docs = docs.drop(out)

    def run(batches):
        for b in slices(batches, 500):
            x = np.array([statistics(t) for t in texts(b.column("text"))]).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x))], [*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast("double")).schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Repeated rows give repeated results; a row without doc_id is scored and not held out.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
