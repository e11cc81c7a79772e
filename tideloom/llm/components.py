"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a, b) with a > b.

    Large: every node's larger neighbours go to its smallest one. Small: the node and its smaller
    neighbours go to the smallest. A node with very many edges is one row per task in the minimum
    and is split in the join, since both of its sides are read from storage.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("low")), "lows")
        out = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
    else:
        low = written(edges.groupBy("a").agg(F.min("b").alias("low")), "lows")
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of every node that has an edge but is no root; a root is the smallest node reachable.

    ``edges`` has two bigint columns a and b; direction, repeats and loops don't matter. Rounds grow with the
    logarithm of the longest path. Each round is written to the shared folder, so a lost executor costs
    one round at most; only a count and a checksum come to the driver. No edges give no rows.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        edges = written(_star(_star(edges, large=True), large=False), "edges")
