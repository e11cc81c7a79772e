"""Benchmark decontamination by greedy string tiling.

Documents and test items that share a seed of LEAST tokens are joined. For each such pair the longest common
runs of tokens are marked first, found by running Karp-Rabin hashes, each token once on either side, until
no run of LEAST tokens is left. An item is leaked into a document when the marked tiles cover enough of it, in
whatever order they stand.

A filter of fixed size over all seeds of the benchmark lets most documents go without a join; it passes too much
at worst, never too little.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fixed_filter, passes, slices, texts, written
from .substrings import rolled

LEAST = 5  # tokens of the shortest tile; items of fewer tokens take no part
COVERED = 0.6  # share of an item's tokens under tiles from which it counts as leaked
TOKEN = re.compile(r"\w+")


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def seeds(words: list[str], least: int = LEAST) -> np.ndarray:
    """The hash of every ``least`` consecutive tokens."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, map(str.encode, words)), np.uint64, len(words))
    return rolled(h, least)


def _runs(doc: np.ndarray, item: np.ndarray, size: int, free_doc: np.ndarray, free_item: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, place in item, place in doc) of the maximal common runs of at least ``size`` free tokens."""
    def windows(seq, free):
        h = rolled(seq, size)
        whole = np.convolve(free, np.ones(size, np.int64), "valid") == size if len(free) >= size else np.zeros(0, bool)
        return h, np.flatnonzero(whole)

    hi, at_i = windows(item, free_item)
    hd, at_d = windows(doc, free_doc)
    at_d = at_d[np.isin(hd[at_d], hi[at_i])] if len(at_i) else at_d[:0]
    if not len(at_d):
        return []
    order = at_i[np.argsort(hi[at_i], kind="stable")]
    lo, up = np.searchsorted(hi[order], hd[at_d], "left"), np.searchsorted(hi[order], hd[at_d], "right")
    n = up - lo
    d = np.repeat(at_d, n)
    i = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
    by = np.lexsort((i, d - i))
    d, i = d[by], i[by]
    new = np.concatenate(([True], (np.diff(d - i) != 0) | (np.diff(i) != 1)))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(i))) + size - 1
    return [(int(x), int(a), int(b)) for x, a, b in zip(length, i[first], d[first], strict=True)]


def tiles(doc: list[str], item: list[str], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the greedy tiling, the longest first; on ties the earliest in the item."""
    ids = {w: k for k, w in enumerate(dict.fromkeys(item), 1)}
    hashes = np.concatenate(([np.uint64(0)], np.fromiter(map(xxhash.xxh3_64_intdigest, map(str.encode, ids)), np.uint64, len(ids))))
    d = hashes[np.fromiter((ids.get(w, 0) for w in doc), np.int64, len(doc))]
    i = hashes[np.fromiter((ids[w] for w in item), np.int64, len(item))]
    free_doc, free_item, found, size = (d != 0).astype(np.int64), np.ones(len(i), np.int64), [], len(i)
    while size >= least:
        heap = [(-n, a, b) for n, a, b in _runs(d, i, size, free_doc, free_item)]
        heapq.heapify(heap)
        while heap:
            n, a, b = heapq.heappop(heap)
            n = -n
            open_ones = free_item[a : a + n] & free_doc[b : b + n]
            if open_ones.all():
                found.append((a, b, n))
                free_item[a : a + n] = free_doc[b : b + n] = 0
            else:  # what others have left of it
                edge = np.diff(np.concatenate(([0], open_ones, [0])))
                for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    if e - s >= size:
                        heapq.heappush(heap, (s - e, a + s, b + s))
        size = max(size // 2, least) if size > least else 0
    return found


def _seed_rows(least: int):
    def run(batches):
        for b in slices(batches, 200):
            rows = []
            for key, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                h = seeds(words := tokens(text), least)
                rows.append((np.full(len(h), key), h, np.full(len(h), len(words))))
            key, h, n = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.uint64)] * 3
            cols = [pa.array(key.astype(np.int64)), pa.array(h.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["item", "seed", "size"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = LEAST) -> DataFrame:
    """(doc_id, row, item_id, n_tiles, covered_tokens, coverage) of every document and item leaked into it.

    Null and empty texts leak nothing. Items are told apart by item_id and text, so repeated ones give one row, repeated documents
    with the same doc_id as well. row is a hash of doc_id and text that with doc_id names a document.
    """
    items = written(benchmark.select("item_id", F.col("text").alias("item_text")).filter("item_text is not null").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    parts = items.select("item", "item_text").mapInArrow(_seed_rows(least), "item bigint, seed bigint, size int")
    parts = written(parts, "seeds")
    bits = fixed_filter(parts, "seed")
    of_seed = written(parts.groupBy("seed", "item").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")), "seeds")

    def hits(batches):
        for b in slices(batches, 300):
            kept, found = [], []
            for at, text in enumerate(texts(b.column("text"))):
                h = seeds(tokens(text), least)
                passed = h[passes(bits, h)]
                if len(passed):
                    kept.append(at)
                    found.append(np.unique(passed).view(np.int64))
            rows = b.take(pa.array(kept, pa.int64()))
            lists = pa.array([f.tolist() for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, "seeds"])

    own = docs.select("doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    near = own.mapInArrow(hits, "doc_id bigint, text string, row bigint, seeds array<bigint>")
    near = written(near.withColumn("uid", F.monotonically_increasing_id()), "near")
    shared = near.select("uid", F.explode("seeds").alias("seed")).join(of_seed, "seed")
    # every tile of n tokens holds n - least + 1 seeds of the item, which is n / least at least
    pairs = shared.groupBy("uid", "item").agg(F.sum("n").alias("n"), F.first("size").alias("size"))
    pairs = written(pairs.filter(F.col("n") * least >= F.col("size") * covered).select("uid", "item"), "pairs")
    both = written(pairs.join(items, "item"), "pairs").join(near.select("uid", "doc_id", "row", "text"), "uid")

    def tile(batches):
        for b in slices(batches, 200):
            found = [tiles(tokens(t), tokens(i), least) for t, i in zip(b.column("text").to_pylist(), b.column("item_text").to_pylist(), strict=True)]
            sums = [sum(n for *_, n in f) for f in found]
            sizes = [len(tokens(i)) for i in b.column("item_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), b.column("item_id"), pa.array([len(f) for f in found], pa.int32()),
                 pa.array(sums, pa.int32()), pa.array([s / n for s, n in zip(sums, sizes, strict=True)], pa.float64())],
                ["doc_id", "row", "item_id", "n_tiles", "covered_tokens", "coverage"],
            )

    shape = "doc_id bigint, row bigint, item_id bigint, n_tiles int, covered_tokens int, coverage double"
    return both.mapInArrow(tile, shape).filter(F.col("coverage") >= covered).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, least: int = LEAST) -> DataFrame:
    """``docs`` without those that hold a leaked item; all other rows pass unchanged."""
    bad = written(leaks(docs, benchmark, covered, least).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == bad["_row"]), "left_anti")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_tiles, covered_tokens and coverage of every leak."""
    return leaks(docs, benchmark).drop("row")
