"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, components of the links.

Two fingerprints that differ in at most r of 64 bits agree on at least b - r of any b blocks of bits. So
every choice of b - r blocks, with the bits in them, names a shard, and linked fingerprints meet in at least one. Each
shard becomes a BK-tree whose children are keyed by their integer Hamming distance to the parent; a search
follows only the edges within the radius of its own distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, written
from .components import components

BITS = 64
PART = 8192  # fingerprints of a shard that one tree holds; larger shards become several trees
BLOCK = 1 << 14  # shingles whose bits are counted at once


def fingerprint(text: str, words: int, seed: int) -> int:
    """The SimHash of a text, as a signed 64-bit integer; 0 for a text without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        cuts = zip(starts[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        h = np.array([digest(joined[s:e], seed) for s, e in cuts], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in the bigint column _print. Null texts count as empty."""
    docs = docs.drop("_print")

    def run(batches):
        for b in slices(batches, 500):
            own = pa.array([fingerprint(t, words, seed) for t in texts(b.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, own], [*b.schema.names, "_print"])

    return docs.mapInArrow(run, docs.withColumn("_print", F.lit(None).cast("bigint")).schema)


def masks(radius: int, blocks: int) -> list[int]:
    """Signed masks of every choice of blocks - radius blocks of the 64 bits."""
    cut = np.linspace(0, BITS, blocks + 1).round().astype(int).tolist()
    block = [(1 << e) - (1 << s) for s, e in zip(cut[:-1], cut[1:], strict=True)]
    each = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in each]


class Tree:
    """A BK-tree that knows which of its fingerprints are connected.

    All that hang beneath an edge of at most the radius are linked to the parent, so they are one
    component. A search that is itself linked to the parent needn't enter those edges, which keeps
    large groups of near copies linear.
    """

    def __init__(self, radius: int):
        self.radius, self.nodes, self.children, self.parent = radius, [], [], []

    def root(self, i: int) -> int:
        up = self.parent
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def add(self, x: int) -> None:
        """Insert a fingerprint and link it to all components within the radius."""
        new = len(self.nodes)
        self.nodes.append(x)
        self.children.append({})
        self.parent.append(new)
        if new:
            at = 0
            while True:
                d = (x ^ self.nodes[at]).bit_count()
                nxt = self.children[at].setdefault(d, new)
                if nxt == new:
                    break
                at = nxt
            self.link(x, new)

    def link(self, x: int, i: int) -> None:
        """Connect entry i, whose fingerprint is x, with every component that has one within the radius."""
        r, stack = self.radius, [0]
        while stack:
            at = stack.pop()
            if at == i:
                d = 0
            else:
                d = (x ^ self.nodes[at]).bit_count()
                if d <= r:
                    self.union(at, i)
            near = d <= r
            for edge, child in self.children[at].items():
                if d - r <= edge <= d + r and not (near and edge <= r and self.root(child) == self.root(i)):
                    stack.append(child)

    def pairs(self) -> list[tuple[int, int]]:
        """Each entry with the first of its component, both by number."""
        return [(i, j) for i in range(len(self.nodes)) if (j := self.root(i)) != i]


def tree_edges(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """A star for each component of the signed fingerprints of a shard: they are connected exactly as by all their links."""
    tree = Tree(radius)
    for x in prints:
        tree.add(x % (1 << BITS))
    return [(prints[i], prints[j]) for i, j in tree.pairs()]


def in_trees(dealt: DataFrame, part: int) -> DataFrame:
    """``dealt`` with the tree of each row instead of its shard; a row of a shard above ``part`` is in several trees."""
    many = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > part)
    many = written(many.select("shard", F.ceil(F.col("rows") / part).cast("int").alias("parts")), "shards")
    names = [c for c in dealt.columns if c != "shard"]
    dealt = dealt.join(many, "shard", "left") if many.take(1) else dealt.withColumn("parts", F.lit(None).cast("int"))
    own = F.pmod(F.hash("print"), F.col("parts"))
    # cell i, j (i <= j) holds parts i and j; parts meet in exactly one cell, a part itself in all of its own
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64("shard", F.least(o, own), F.greatest(o, own)))
    return dealt.select(*names, F.explode(F.coalesce(cells, F.array("shard"))).alias("tree"))


def shard_edges(dealt: DataFrame, radius: int, part: int = PART) -> DataFrame:
    """Edges (a, b) of all shards in ``dealt`` (shard, print), as tree_edges() gives them.

    Every shard has an order of its own, so that a group that lies in several has several roots. A shard above ``part``
    fingerprints is dealt into parts; each pair of parts makes one tree, so that no task holds more than two parts
    and every link is still seen. Trees are built where the rows of their shard meet and live in one task.
    """
    dealt = in_trees(dealt, part)

    def run(batches):
        tree, prints, found = None, [], []
        for b in batches:
            trees = b.column("tree").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], trees[1:] != trees[:-1]))) if len(trees) else np.zeros(0, int)
            own = b.column("print").to_pylist()
            for s, e in zip(starts, [*starts[1:], len(trees)], strict=True):
                if trees[s] != tree:
                    if len(prints) > 1:
                        found += tree_edges(prints, radius)
                    tree, prints = trees[s], []
                prints += own[s:e]
            yield _edge_batch(found)
            found = []
        if len(prints) > 1:
            yield _edge_batch(tree_edges(prints, radius))

    return dealt.repartition("tree").sortWithinPartitions("tree", F.xxhash64("tree", "print")).mapInArrow(run, "a bigint, b bigint").distinct()


def links(prints: DataFrame, radius: int = 4, blocks: int = 6, part: int = PART) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints in ``prints`` exactly as all their links do."""
    shard = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("_print").bitwiseAND(F.lit(m))) for i, m in enumerate(masks(radius, blocks))]))
    return shard_edges(prints.select(shard.alias("shard"), F.col("_print").alias("print")), radius, part)


def _edge_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``.

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows give
    repeated results. component_id is the smallest doc_id reachable; rows without one don't name a
    component, and it is null where no row of the component has one.
    """
    own = written(fingerprints(docs.select("doc_id", "text"), words, seed).select("doc_id", "_print"), "prints")
    firsts = written(own.groupBy("_print").agg(F.min("doc_id").alias("first_id")), "firsts")
    root_of = components(links(firsts, radius, blocks))
    placed = firsts.join(root_of, firsts["_print"] == root_of["node"], "left")
    placed = written(placed.select("_print", "first_id", F.coalesce("root", "_print").alias("root")), "placed")
    named = written(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    of_print = written(placed.join(named, "root").select("_print", "component_id"), "components")
    return own.join(of_print, "_print").select(
        "doc_id", F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int = 6, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each component that near_duplicates() finds: that with the smallest doc_id.

    A document without doc_id stays only in a component where none has one; of several with the smallest doc_id one of the
    smallest hash of its text stays, and repeated rows become one. Empty texts are copies of each other.
    """
    own = written(fingerprints(docs.select("doc_id", "text"), words, seed).select("doc_id", F.xxhash64("text").alias("row"), "_print"), "prints")
    firsts = own.groupBy("_print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    firsts = written(firsts, "firsts")
    root_of = components(links(firsts, radius, blocks))
    placed = firsts.join(root_of, firsts["_print"] == root_of["node"], "left").select("first", F.coalesce("root", "_print").alias("root"))
    chosen = placed.groupBy("root").agg(F.min("first").alias("c"))
    chosen = written(chosen.select(F.col("c.doc_id").alias("_id"), F.col("c.row").alias("_row")), "chosen")
    kept = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["_id"]) & (F.xxhash64(docs["text"]) == chosen["_row"]), "left_semi")
    repeats = own.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if repeats.take(1) else kept
