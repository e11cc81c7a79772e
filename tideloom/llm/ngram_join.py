"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once.

The sets of word shingles are put in one order, rare shingles first. Sets of a similarity share a shingle of their prefixes, which are
a fifth of each at 0.8; shingles that occur in one set only fill most prefixes, so few sets have any shared one left. (1) Distinct sets
send their shingles in blocks that were sorted and counted in the map task; a bucket of shingles tells which occur again and how
often. (2) The shared shingles of each set give its prefix. (3) Sets that share a prefix shingle, fit in length and by their places, are candidates.

Classes of linked sets are asked for, so a large group isn't expanded into pairs: first every set meets a few random neighbours in its
lists, and links that hold join their labels, again and again until few are found. Then all pairs of different labels that share a prefix shingle
are compared by the filters, the suffix filter last: sets that differ in more counts of shingles by hash range than linked ones
can differ in shingles aren't linked. What is left is verified. So no link between labels is lost, whatever the rounds have found.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fixed_filter, list_array, passes, slices, texts, written
from .components import components
from .substrings import rolled

WORDS = 5
PERCENT = 80  # of the union that linked sets share
BUCKET = 1 << 17  # counted shingles of a bucket, about
CHUNK = 1 << 20  # shingles that a map task sorts at once
HOT = 8  # sets of a chunk from which a shingle's sets don't go to its bucket, only their number
PART = 2048  # sets of a list that meet in one task; longer lists are dealt into parts
ROUNDS = 8  # of random neighbours, at most
FEW = 20  # rounds end when one finds less than this part of the first one's links
MOST = 1 << 20  # candidates that a task holds before it gives them out
RANGES = 128  # of hashes, for the suffix filter


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a shorter text is one shingle, a text without words none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return np.unique(rolled(h, min(words, len(found))))


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def classes(own: np.ndarray, bits: int) -> np.ndarray:
    """Shingles by their first 33 + bits bits, distinct and sorted. Counted are those whose first bit is 0; the others come after them."""
    return np.unique(own >> np.uint64(31 - bits)).astype(np.int64)


def set_rows(docs: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """(doc_id, raw, set_id, n, counted, spill) of every row: the set of its text, how many of its classes are counted, and the
    others that belong to the prefix because the counted ones are too few."""

    def run(batches):
        for b in slices(batches, 300):
            out = []
            for own in (shingles(t, words) for t in texts(b.column("text"))):
                c = classes(own, bits)
                counted = int(np.searchsorted(c, 1 << (32 + bits)))
                spill = c[counted : max(counted, prefix_length(len(own), percent))] if len(own) else c
                out.append((xxhash.xxh3_64_intdigest(own.tobytes()), len(own), counted, spill))
            ids, n, counted, spill = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("raw"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(counted, pa.int32()), list_array(list(spill), pa.int64())],
                ["doc_id", "raw", "set_id", "n", "counted", "spill"],
            )

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    return written(own.mapInArrow(run, "doc_id bigint, raw bigint, set_id bigint, n int, counted int, spill array<bigint>"), "rows")


def chosen_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(set_id, text): one text of each set in ``chosen`` (repeated rows repeat it)."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    return own.join(chosen, (own["raw"] == chosen["raw"]) & own["doc_id"].eqNullSafe(chosen["doc_id"])).select("set_id", "text")


def perhaps_in(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text may be in ``chosen``, by a filter of fixed size: other texts needn't be shuffled to be dropped."""
    bits = fixed_filter(chosen, "raw")

    @F.pandas_udf("boolean")
    def perhaps(raw: pd.Series) -> pd.Series:
        return pd.Series(passes(bits, raw.to_numpy().view(np.uint64)))

    return docs.filter(perhaps(F.xxhash64("text")))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)


def _lists(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


BLOCKS = "bucket int, low array<int>, owners array<bigint>, hot_low array<int>, hot_n array<int>, token bigint"


def blocks(own: DataFrame, words: int, bits: int) -> DataFrame:
    """The counted classes of (set_id, text), sorted in chunks: one row for each bucket of a chunk.

    low and owners are the classes within the bucket and their sets. Of a class that HOT sets of the chunk have, the bucket gets
    only the number, in hot_low and hot_n; the sets go out beside it in a row with the whole ``token``, in any of many
    buckets below 0. So a bucket holds a bounded part of every chunk, however many sets share a shingle.
    """

    def send(held):
        c = np.concatenate([x for _, x in held])
        owner = np.repeat(np.array([i for i, _ in held], np.int64), [len(x) for _, x in held])
        order = np.argsort(c, kind="stable")
        c, owner = c[order], owner[order]
        at = _runs(c)
        size = np.diff(at)
        hot = np.flatnonzero(size >= HOT)
        cold = np.repeat(size < HOT, size)
        low, of = c[cold], owner[cold]
        hot_c, hot_n = c[at[hot]], size[hot]
        buckets = np.unique(np.concatenate((low, hot_c)) >> 32)
        cut = lambda x: np.append(np.searchsorted(x, buckets << 32), len(x))
        ints = lambda x: (x & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), _lists(ints(low), cut(low), pa.int32()), _lists(of, cut(low), pa.int64()),
             _lists(ints(hot_c), cut(hot_c), pa.int32()), _lists(hot_n, cut(hot_c), pa.int32()), pa.nulls(len(buckets), pa.int64())],
            [f.split()[0] for f in BLOCKS.split(", ")],
        )
        if len(hot):
            none = pa.nulls(len(hot), pa.list_(pa.int32()))
            sets = [owner[at[i] : at[i + 1]] for i in hot]
            anywhere = -1 - (hot_c ^ np.array([s[0] for s in sets])) % 4096
            yield pa.RecordBatch.from_arrays([pa.array(anywhere, pa.int32()), none, list_array(sets, pa.int64()), none, none, pa.array(hot_c)], [f.split()[0] for f in BLOCKS.split(", ")])

    def run(batches):
        held, size = {}, 0
        for b in slices(batches, 300):
            for i, t in zip(b.column("set_id").to_pylist(), texts(b.column("text")), strict=True):
                if i not in held:
                    c = classes(shingles(t, words), bits)
                    held[i] = c[: np.searchsorted(c, 1 << (32 + bits))]
                    size += len(held[i])
                if size >= CHUNK:
                    yield from send(held.items())
                    held, size = {}, 0
        if size:
            yield from send(held.items())

    return own.mapInArrow(run, BLOCKS)


def shared_classes(dealt: DataFrame) -> DataFrame:
    """(token, df, owners, hot): the classes in blocks() that several sets have, and how many.

    A row without df holds more owners of a class that some row marked hot has the df of.
    """

    def count(bucket, rows):
        low, owner, hot_low, hot_n = (np.concatenate([r[k].values.to_numpy() for r in rows]) for k in range(4))
        order = np.lexsort((owner, low))
        low, owner = low[order], owner[order]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])))[: len(low)]
        low, owner = low[new], owner[new]
        hot, back = np.unique(hot_low, return_inverse=True)
        n = np.bincount(back, hot_n, len(hot)).astype(np.int64)
        at = _runs(low)
        own = low[at[:-1]]
        place = np.searchsorted(hot, own)
        is_hot = np.isin(own, hot)
        df = np.diff(at) + np.where(is_hot, n[np.minimum(place, len(hot) - 1)] if len(hot) else 0, 0)
        keep = np.flatnonzero(df > 1)
        only = ~np.isin(hot, own)
        token = np.concatenate((own[keep], hot[only])).astype(np.int64) & 0xFFFFFFFF | bucket << 32
        lists = list_array([*(owner[at[i] : at[i + 1]] for i in keep), *([owner[:0]] * int(only.sum()))], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(token), pa.array(np.concatenate((df[keep], n[only]))), lists, pa.array(np.concatenate((is_hot[keep], only[only])))], ["token", "df", "owners", "hot"]
        )

    def run(batches):
        now, rows = None, []
        for b in batches:
            beside = b.filter(pc.less(b.column("bucket"), 0))
            if beside.num_rows:
                yield pa.RecordBatch.from_arrays([beside.column("token"), pa.nulls(beside.num_rows, pa.int64()), beside.column("owners"), pa.array([False] * beside.num_rows)], ["token", "df", "owners", "hot"])
            cols = [b.column(c) for c in ("low", "owners", "hot_low", "hot_n")]
            for i, bucket in enumerate(b.column("bucket").to_pylist()):
                if bucket < 0:
                    continue
                if bucket != now and rows:
                    yield count(now, rows)
                    rows = []
                now = bucket
                rows.append([c[i] for c in cols])
        if rows:
            yield count(now, rows)

    dealt = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return written(dealt.mapInArrow(run, "token bigint, df bigint, owners array<bigint>, hot boolean"), "shared")


def prefix_lists(chosen: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(token, rows, set_id, n, pos): the prefix classes that several sets have in their prefixes, with their place in each set."""
    known = shared.filter("hot").select("token", F.col("df").alias("all"))
    beside = shared.filter("df is null").join(known, "token").select("token", F.col("all").alias("df"), "owners")
    each = shared.filter("df is not null").select("token", "df", "owners").unionByName(beside).select(F.explode("owners").alias("set_id"), "df", "token")
    ranked = each.groupBy("set_id").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("ranked"))
    own = chosen.select("set_id", "n", "counted", "spill").join(ranked, "set_id", "left")
    # shingles that no other set has come first, then the shared ones by frequency, then those that aren't counted
    own = own.withColumn("ranked", F.coalesce("ranked", F.array().cast("array<struct<df:bigint,token:bigint>>")))
    own = own.withColumn("alone", F.col("counted") - F.size("ranked")).withColumn("take", F.expr(f"least(size(ranked), greatest(0, n - ({percent}L * n + 99) div 100 + 1 - alone))").cast("int"))
    first = F.transform(F.slice("ranked", 1, F.col("take")), lambda x, i: F.struct(x["token"].alias("token"), (F.col("alone") + i).alias("pos")))
    last = F.transform("spill", lambda x, i: F.struct(x.alias("token"), (F.col("counted") + i).alias("pos")))
    postings = own.select("set_id", "n", F.explode(F.concat(first, last)).alias("p")).select("p.token", "set_id", "n", "p.pos")
    postings = written(postings, "postings")
    rows = postings.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return written(postings.join(rows, "token").select("token", "rows", "set_id", "n", "pos"), "lists")


def whole_sets(docs: DataFrame, chosen: DataFrame, lists: DataFrame, words: int) -> DataFrame:
    """(set_id, own, ranges) of the sets in ``lists``: all shingles, and how many lie in each range of hashes (255 and more alike)."""

    def run(batches):
        for b in slices(batches, 300):
            own = [shingles(t, words) for t in texts(b.column("text"))]
            counts = [np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes() for s in own]
            yield pa.RecordBatch.from_arrays([b.column("set_id"), list_array([s.view(np.int64) for s in own], pa.int64()), pa.array(counts, pa.binary())], ["set_id", "own", "ranges"])

    wanted = chosen.join(lists.select("set_id").distinct(), "set_id", "left_semi")
    wanted = written(wanted.select("set_id", "raw", "doc_id"), "wanted")
    found = chosen_texts(perhaps_in(docs, wanted), wanted).mapInArrow(run, "set_id bigint, own array<bigint>, ranges binary")
    return written(found.groupBy("set_id").agg(F.first("own").alias("own"), F.first("ranges").alias("ranges")), "sets")


def overlap(percent: int, n: str = "n", m: str = "m") -> str:
    """SQL for the shingles that linked sets of these sizes share at least."""
    return f"({percent}L * ({n} + {m}) + {99 + percent}) div {100 + percent}"


def neighbours(lists: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs (a, b) of sets with different labels that lie side by side in a random order of one of their lists: four of each set at most.

    All other pairs are apart()'s.
    """
    part = F.pmod(F.xxhash64("set_id", F.lit(seed)), F.ceil(F.col("rows") / PART))
    order = Window.partitionBy("token", "part").orderBy(F.xxhash64("set_id", "token", F.lit(seed)), "set_id")
    before = F.lag(F.struct("set_id", "n", "pos", "label")).over(order)
    near = lists.withColumn("part", part).withColumn("o", before).filter("o.label != label").withColumns({"m": F.col("o.n"), "other": F.col("o.set_id")})
    near = near.filter(f"100L * least(n, m) >= {percent}L * greatest(n, m) AND least(n - pos, m - o.pos) >= {overlap(percent)}")
    key = lambda k: F.struct(F.xxhash64("set_id", "other", F.lit(seed), F.lit(k)).alias("key"), "other")
    four = near.groupBy("set_id").agg(*[take(key(k)).alias(f"{name}{k}") for k in (0, 1) for name, take in (("low", F.min), ("high", F.max))])
    pairs = four.select("set_id", F.explode(F.array("low0.other", "high0.other", "low1.other", "high1.other")).alias("other"))
    return pairs.select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b")).distinct()


def apart(lists: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that share a prefix class and pass the length, positional and suffix filters.

    A list above PART sets is dealt into parts; each pair of parts is one cell, so that no task holds more than two parts of a
    list. ``home`` of a list is its set of the smallest hash: lists of much the same sets share it, and their cells come one after
    the other in one task, which names a pair only once for all of them.
    """
    parts = F.ceil(F.col("most") / PART).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("low"), F.greatest(o, F.col("part")).alias("high")))
    homes = lists.groupBy("home").agg(F.max("rows").alias("most"))
    dealt = lists.join(homes, "home").join(found.select("set_id", "ranges"), "set_id")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("set_id"), parts).cast("int")).withColumn("cell", F.explode(cells))
    dealt = dealt.select(F.xxhash64("home", "cell").alias("cell"), "token", (F.col("cell.low") == F.col("cell.high")).alias("inner"), "part", "set_id", "n", "pos", "label", "ranges")

    def compare(held):
        t = pa.Table.from_batches(held)
        n, pos, label, part, ids = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "label", "part", "set_id"))
        inner = t.column("inner")[0].as_py()
        ranges = np.frombuffer(b"".join(t.column("ranges").to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int16)
        out = []
        for at in range(0, len(n), 64):
            i, j = slice(at, at + 64), slice(0, at + 64)
            low, high = np.minimum(n[i, None], n[None, j]), np.maximum(n[i, None], n[None, j])
            need = (percent * (low + high) + 99 + percent) // (100 + percent)
            fit = (label[i, None] != label[None, j]) & (100 * low >= percent * high) & (np.minimum((n - pos)[i, None], (n - pos)[None, j]) >= need)
            fit &= np.arange(len(n))[None, j] < np.arange(len(n))[i, None]
            if not inner:
                fit &= part[i, None] != part[None, j]
            x, y = np.nonzero(fit)
            for k in range(0, len(x), 1 << 14):
                a, b = x[k : k + (1 << 14)] + at, y[k : k + (1 << 14)]
                apart_by = np.abs(ranges[a] - ranges[b]).sum(axis=1, dtype=np.int64)
                near = apart_by <= n[a] + n[b] - 2 * need[a - at, b]
                out.append(np.stack((np.minimum(ids[a], ids[b])[near], np.maximum(ids[a], ids[b])[near])))
        return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)

    def once(pairs):
        both = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    def run(batches):
        held, now, pairs, size = [], None, [], 0
        for b in batches:
            cell, token = b.column("cell").to_numpy(), b.column("token").to_numpy()
            at = np.union1d(_runs(cell), _runs(token))
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                key = (cell[s], token[s])
                if held and key != now:
                    pairs.append(compare(held))
                    size += pairs[-1].shape[1]
                    if key[0] != now[0] or size > MOST:
                        yield once(pairs)
                        pairs, size = [], 0
                    held = []
                now = key
                held.append(b.slice(s, e - s))
        if held:
            yield once([*pairs, compare(held)])

    return dealt.repartition("cell").sortWithinPartitions("cell", "token").mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets in ``found`` are linked."""

    def run(batches):
        for b in slices(batches, 200):
            both, sizes = [], []
            for x, y in zip(b.column("own_a"), b.column("own_b"), strict=True):
                x, y = x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64)
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                sizes.append(len(x) + len(y))
            both, sizes = np.array(both, np.int64), np.array(sizes, np.int64)
            yield b.filter(pa.array(100 * both >= percent * (sizes - both))).select(["a", "b"])

    own = found.select("set_id", "own")
    first = pairs.join(own.withColumnsRenamed({"set_id": "a", "own": "own_a"}), "a")
    both = first.join(own.withColumnsRenamed({"set_id": "b", "own": "own_b"}), "b").select("a", "b", "own_a", "own_b")
    return written(both.mapInArrow(run, "a bigint, b bigint"), "links")


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_id, n) of every row of ``docs``, and (node, root) of the sets that links join to a smaller one.

    Two sets are linked when 100 times their intersection is at least ``percent`` times their union. Null and empty texts have
    no shingles and no links; texts of equal sets are one set. Repeated rows give repeated rows.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(30, max(4, math.ceil(math.log2(max(1, chars / 12 / BUCKET)))))
    rows = set_rows(docs, words, percent, bits)
    chosen = rows.filter("n > 0").groupBy("set_id").agg(F.min(F.struct("raw", "doc_id")).alias("who"), *[F.first(c).alias(c) for c in ("n", "counted", "spill")])
    chosen = written(chosen.select("set_id", "who.*", "n", "counted", "spill"), "chosen")
    shared = shared_classes(blocks(chosen_texts(docs, chosen.select("set_id", "raw", "doc_id")), words, bits))
    lists = prefix_lists(chosen, shared, percent)
    found = whole_sets(docs, chosen, lists, words)
    links, root_of, first, r, more = None, None, 0, 0, True
    while True:
        label = F.col("set_id") if root_of is None else F.coalesce("root", "set_id")
        told = lists if root_of is None else lists.join(root_of, lists["set_id"] == root_of["node"], "left")
        told = told.select("token", "rows", "set_id", "n", "pos", label.alias("label"))
        if r:
            several = told.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.xxhash64("set_id")).alias("home"))
            told = written(told.join(several.filter("low != high").select("token", "home"), "token"), "told")
        pairs = neighbours(told, percent, r) if more else apart(told, found, percent)
        new = verified(pairs, found, percent)
        links = new if links is None else links.unionByName(new)
        root_of = components(links)
        if not more:
            break
        count, r = new.count(), r + 1
        first = first or count
        more = count * FEW > first and r < ROUNDS
    return rows.select("doc_id", "set_id", "n"), root_of


def report(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable by links. A row without doc_id doesn't name a component, and it is null
    where no row of the component has one; a row without words is a component of its own.
    """
    rows, root_of = joined(docs.select("doc_id", "text"), words, percent)
    some = rows.filter("n > 0")
    firsts = some.groupBy("set_id").agg(F.min("doc_id").alias("first_id"))
    placed = written(firsts.join(root_of, firsts["set_id"] == root_of["node"], "left").select("set_id", "first_id", F.coalesce("root", "set_id").alias("root")), "placed")
    named = written(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "named")
    of_set = written(placed.join(named, "root").select("set_id", "component_id"), "components")
    out = some.join(of_set, "set_id").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id")
    return out.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id")))
