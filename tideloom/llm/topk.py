"""Exact top-k inner products by a uniform threshold in three phases.

The dimensions are cut into nodes; a score is the sum of its nodes' local scores. Phase one gathers the best local
scores of every node and adds up the exact scores of those few vectors, whose k-th best is a score that k
vectors are known to reach. That cutoff over the number of nodes is safe: a vector below it on every node can't
reach the cutoff in sum. Phase two sends each query's cutoff along with the query and collects the vectors that pass on
any node. Phase three bounds their missing local scores by the threshold and resolves what remains exactly.

Vectors and queries are dealt into blocks; a pair of blocks is one task of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

NODES = 2
ROWS = 2048  # vectors of a block
QUERIES = 1024  # queries of a block
EXACT = 2**53  # doubles hold all integers below


def quantized(vectors: DataFrame, step: float = 256.0, column: str = "embedding") -> DataFrame:
    """(uid, vec_id, v, dims) of the rows that take part; v holds floor(step * x) of each component.

    Rows without vec_id or vector, and those with a null, NaN or infinite component take no part. uid
    tells repeated rows apart.
    """
    x = F.col(column)
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    own = vectors.select("vec_id", F.col(column).cast("array<double>").alias(column))
    own = own.filter(F.col("vec_id").isNotNull() & x.isNotNull() & good)
    ints = F.transform(x, lambda c: F.floor(F.lit(step) * c).cast("long"))
    return written(own.select(F.monotonically_increasing_id().alias("uid"), "vec_id", ints.alias("v"), F.size(x).alias("dims")), "vectors")


def _cells(own: DataFrame, queries: DataFrame, rows: int, block: int) -> DataFrame:
    """Every vector in the cells of its block, every query in those of its own: rows of (cell, is_query, ...)."""
    n_rows, n_queries = -(-own.count() // rows) or 1, -(-queries.count() // block) or 1
    deal = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n))
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    cell = lambda r, q: F.concat_ws(":", "dims", r, q).alias("cell")
    columns = ["uid", "vec_id", "v"]
    as_rows = own.select("*", deal(n_rows, 1).alias("own"), across(n_queries)).select(
        cell("own", "other"), F.lit(False).alias("is_query"), *columns, F.lit(None).cast("long").alias("cutoff")
    )
    as_queries = queries.select("*", deal(n_queries, 2).alias("own"), across(n_rows)).select(cell("other", "own"), F.lit(True).alias("is_query"), *columns, "cutoff")
    return as_rows.unionByName(as_queries)


def _matrices(table: pa.Table) -> tuple:
    """Queries and vectors of a cell, in the order of ties, as arrays that multiply without rounding."""
    out = []
    for is_query in (True, False):
        part = table.filter(pa.compute.equal(table["is_query"], is_query)).sort_by([("vec_id", "ascending"), ("uid", "ascending")]).combine_chunks()
        v = part["v"].combine_chunks() if part.num_rows else None
        out += [part, v.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) if v is not None else None]
    queries, q, rows, x = out
    if q is not None and x is not None:
        largest = int(max(map(abs, (q.min(initial=0), q.max(initial=0))))) * int(max(map(abs, (x.min(initial=0), x.max(initial=0)))))
        kind = np.float64 if largest * max(1, q.shape[1]) < EXACT else object
        q, x = q.astype(kind), x.astype(kind)
    return queries, q, rows, x


def _local(q: np.ndarray, x: np.ndarray, nodes: int) -> list[np.ndarray]:
    """The local scores of every node, queries by vectors."""
    cuts = np.linspace(0, q.shape[1], nodes + 1).round().astype(int)
    return [q[:, a:b] @ x[:, a:b].T for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the vectors ``at``, the k with the highest scores; the first on ties."""
    return at[np.lexsort((at, -scores[at].astype(np.float64) if scores.dtype != object else _rank(-scores[at])))[:k]]


def _rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def _result(found: list[tuple], queries: pa.Table, rows: pa.Table) -> pa.Table:
    cols = list(zip(*found, strict=True)) if found else [[], [], []]
    i, j = np.array(cols[0], int), np.array(cols[1], int)
    return pa.table({
        "query": queries["uid"].to_numpy()[i], "query_id": queries["vec_id"].to_numpy()[i],
        "uid": rows["uid"].to_numpy()[j], "vec_id": rows["vec_id"].to_numpy()[j], "score": pa.array([int(s) for s in cols[2]], pa.int64()),
    })


FOUND = "query bigint, query_id bigint, uid bigint, vec_id bigint, score bigint"


def top_k(own: DataFrame, queries: DataFrame, k: int, nodes: int = NODES, rows: int = ROWS, block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores over all rows of ``own`` but itself.

    Both frames come from quantized(); ``queries`` are rows of ``own``. Ties go to the smaller vec_id.
    Vectors of another dimension than the query's have no score with it. Scores must fit 64 bits.
    """

    def gather(table: pa.Table) -> pa.Table:
        qs, q, rs, x = _matrices(table)
        if q is None or x is None:
            return _result([], qs, rs)
        local = _local(q, x, nodes)
        total, ids, every, found = sum(local), rs["uid"].to_numpy(), np.arange(len(x)), []
        for i, uid in enumerate(qs["uid"].to_pylist()):
            others = every[ids != uid]
            lists = [_best(part[i], _above(part[i], others, k), k) for part in local]
            seen = np.unique(np.concatenate(lists))
            found += [(i, j, total[i, j]) for j in _best(total[i], seen, k)]
        return _result(found, qs, rs)

    def resolve(table: pa.Table) -> pa.Table:
        qs, q, rs, x = _matrices(table)
        if q is None or x is None:
            return _result([], qs, rs)
        local, ids, found = _local(q, x, nodes), rs["uid"].to_numpy(), []
        for i, (uid, cutoff) in enumerate(zip(qs["uid"].to_pylist(), qs["cutoff"].to_pylist(), strict=True)):
            mine = np.stack([part[i] for part in local])
            passing = ids != uid
            if cutoff is not None:
                sent = mine * nodes >= cutoff
                bound = (np.where(sent, mine, 0) * nodes).sum(axis=0) + (~sent).sum(axis=0) * cutoff  # times nodes
                passing &= sent.any(axis=0) & (bound >= cutoff * nodes)
            at = np.flatnonzero(passing)
            total = np.zeros(len(x), mine.dtype)
            total[at] = mine[:, at].sum(axis=0)
            if cutoff is not None:
                at = at[total[at] >= cutoff]
            found += [(i, j, total[j]) for j in _best(total, at, k)]
        return _result(found, qs, rs)

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    none = queries.withColumn("cutoff", F.lit(None).cast("long"))
    lists = _cells(own, none, rows, block).groupBy("cell").applyInArrow(gather, FOUND)
    reached = lists.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    cutoffs = reached.filter(F.col("rank") == k).select(F.col("query").alias("uid"), F.col("score").alias("cutoff"))
    armed = written(queries.join(cutoffs, "uid", "left"), "queries")
    entries = _cells(own, armed, rows, block).groupBy("cell").applyInArrow(resolve, FOUND)
    final = entries.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")


def _above(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the vectors ``at`` those that reach the k-th highest score, ties included."""
    if len(at) <= k:
        return at
    own = scores[at]
    return at[own >= (np.partition(own, len(own) - k)[len(own) - k])]


def search(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k best of every row whose vec_id is divisible by ``every``."""
    own = quantized(vectors)
    return top_k(own, own.filter(F.col("vec_id") % every == 0), k)
