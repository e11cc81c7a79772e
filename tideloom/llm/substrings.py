"""Removal of repeated passages: automata of confirmed windows over routed segments.

A window is ``width`` consecutive words. Every window has an anchor: its leftmost smallest hash of GRAM words, which
equal windows share. (1) Anchors are counted; only those that occur again can belong to a repeated window. (2) Around
each such anchor a segment of the text, just the windows that have it as their anchor, is sent to the anchor's shard.
(3) A shard confirms the windows that occur again, compiles them into Aho-Corasick automata over
words, and streams its segments through to locate every occurrence. (4) Located words are taken out.

Texts with the same words are one text here, and all of such a text goes when it is as long as a window. The
segments of a common anchor are dealt over several shards; what they confirm is then counted across
shards first. Hashes of 64 bits tell texts, anchors and windows apart.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, slices, texts, written

WIDTH = 35
GRAM = 12
HOT = 2000  # segments of one anchor in one shard; a common anchor gets more shards
CHUNK = 2000  # segments that share an automaton
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), base))), dtype=np.uint64)[:n]


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes; it doesn't depend on their place."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(words * powers(INVERSE, len(words)), dtype=np.uint64)))
    return mixed((sums[width:] - sums[:-width]) * powers(BASE, n))


def anchors(grams: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For each window the place of its anchor: the leftmost smallest of the gram hashes within."""
    span = width - gram + 1
    n = len(grams) - span + 1
    if n < 1:
        return np.zeros(0, np.int64)
    return np.lib.stride_tricks.sliding_window_view(grams, span).argmin(axis=1) + np.arange(n)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


class Marks:
    """Per-text work of the map side."""

    def __init__(self, width: int, gram: int):
        self.width, self.gram = width, gram

    def marks(self, batches):
        """One row of each text: doc_id, key, raw, n_words, the digest of the unchanged words, and its anchors.

        anchor, at and again are lists of equal length; again tells that the text has the anchor more than once.
        """
        for b in slices(batches, 300):
            keys, counts, digests, lists = [], [], [], ([], [], [])
            for t in texts(b.column("text")):
                words = words_of(t)
                whole = b" ".join(words)
                keys.append(xxhash.xxh3_64_intdigest(whole))
                counts.append(len(words))
                digests.append(hashlib.sha256(whole).digest())
                own = at = np.zeros(0, np.int64)
                again = np.zeros(0, bool)
                if len(words) >= self.width:
                    h = hashes_of(words)
                    grams = rolled(h, self.gram)
                    at = np.unique(anchors(grams, self.width, self.gram))
                    _, back, n = np.unique(grams[at], return_inverse=True, return_counts=True)
                    own, again = grams[at].view(np.int64), n[back] > 1
                for column, part in zip(lists, (own, at.astype(np.int32), again), strict=True):
                    column.append(part)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(_signed(np.array(keys, np.uint64))), b.column("raw"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 *[list_array(column, kind) for column, kind in zip(lists, (pa.int64(), pa.int32(), pa.bool_()), strict=True)]],
                ["doc_id", "key", "raw", "n_words", "whole", "anchor", "at", "again"],
            )

    def _ranges(self, text: str, ats, shards):
        """The words, their hashes, and (anchor hash, first and last window start, shards) of the wanted anchors."""
        words = words_of(text)
        h = hashes_of(words)
        grams = rolled(h, self.gram)
        place = anchors(grams, self.width, self.gram)
        for at, n in zip(ats, shards, strict=True):
            lo, hi = np.searchsorted(place, at), np.searchsorted(place, at, "right")
            if hi > lo:
                yield words, h, int(grams[at]), int(lo), int(hi), n

    def hot_windows(self, batches):
        """(anchor, window) of every window whose anchor has several shards."""
        for b in slices(batches, 300):
            a, w = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for row in b.to_pylist():
                hot = [(at, n) for at, n in zip(row["ats"], row["shards"], strict=True) if n > 1]
                for _, h, anchor, lo, hi, _ in self._ranges(row["text"], *zip(*hot, strict=True)) if hot else ():
                    own = rolled(h[lo : hi - 1 + self.width], self.width)
                    w.append(own)
                    a.append(np.full(len(own), anchor, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(a))), pa.array(_signed(np.concatenate(w)))], ["anchor", "window"])

    def segments(self, batches):
        """(anchor, shard, key, start, words, hot): the words of all windows of one anchor occurrence."""
        for b in slices(batches, 300):
            out = []
            for row in b.to_pylist():
                for words, _, anchor, lo, hi, n in self._ranges(row["text"], row["ats"], row["shards"]):
                    cut = b" ".join(words[lo : hi - 1 + self.width])
                    out.append((anchor, (row["key"] + lo) % n, row["key"], lo, cut.decode("utf-8", "surrogatepass"), n > 1))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(np.array(cols[0], np.uint64))), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                 pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.bool_()), pa.nulls(len(out), pa.int64())],
                ["anchor", "shard", "key", "start", "words", "hot", "window"],
            )

    def locate(self, batches):
        """Stretches (key, first, last) of words that lie in repeated windows, from rows sorted by anchor and shard."""
        held, confirmed, now, group = [], {}, None, -1
        for b in batches:
            cols = [b.column(x).to_pylist() for x in ("anchor", "shard", "key", "start", "words", "hot", "window")]
            for anchor, shard, key, start, words, hot, window in zip(*cols, strict=True):
                if (anchor, shard) != now:
                    if len(held) >= CHUNK:
                        yield self._located(held, confirmed)
                        held, confirmed = [], {}
                    now, group = (anchor, shard), group + 1
                if words is None:
                    confirmed.setdefault(group, set()).add(window % (1 << 64))
                else:
                    held.append((group, hot, key, start, words))
        yield self._located(held, confirmed)

    def _located(self, held: list[tuple], confirmed: dict[int, set]) -> pa.RecordBatch:
        width, ids, table = self.width, {}, []
        ends, stream = [], []
        for *_, words in held:
            stream += [ids.setdefault(w, len(ids) + 1) for w in words_of(words)]
            ends.append(len(stream))
            stream.append(0)  # no word
        if not stream:
            return self._stretches([], held)
        table = np.concatenate(([np.uint64(0)], hashes_of(list(ids))))[np.array(stream)]
        windows = rolled(table, width)
        # the windows of each segment, with the group in which they are counted
        starts = [0, *(e + 1 for e in ends[:-1])]
        at = np.concatenate([np.arange(s, e - width + 1) for s, e in zip(starts, ends, strict=True)])
        sizes = [e - width + 1 - s for s, e in zip(starts, ends, strict=True)]
        group = np.repeat([g for g, *_ in held], sizes)
        hot = np.repeat([x[1] for x in held], sizes)
        own = windows[at]
        order = np.lexsort((own, group))
        new = np.concatenate(([True], (np.diff(group[order]) != 0) | (own[order][1:] != own[order][:-1])))
        counts = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, n in zip(order[new], counts, strict=True):
            if own[i] in confirmed.get(int(group[i]), ()) if hot[i] else n > 1:
                found.add_word(tuple(stream[at[i] : at[i] + width]), 1)
        if not len(found):
            return self._stretches([], held)
        found.make_automaton()
        hits = np.fromiter((end for end, _ in found.iter(tuple(stream))), np.int64)
        return self._stretches(hits, held, starts)

    def _stretches(self, hits, held, starts=()) -> pa.RecordBatch:
        key, first, last = [], [], []
        if len(hits):
            segment = np.searchsorted(starts, hits, "right") - 1
            cut = np.concatenate(([True], (np.diff(segment) != 0) | (np.diff(hits) > self.width)))
            lows, highs = np.flatnonzero(cut), np.concatenate((np.flatnonzero(cut)[1:], [len(hits)])) - 1
            for lo, hi in zip(lows, highs, strict=True):
                s = segment[lo]
                shift = held[s][3] - starts[s]
                key.append(held[s][2])
                first.append(int(hits[lo]) - self.width + 1 + shift)
                last.append(int(hits[hi]) + shift)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["key", "first", "last"])

    def cut(self, batches):
        """key, n_removed and kept: the words that stay, joined by one space."""
        for b in slices(batches, 300):
            n, kept = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    edge[s["first"]] += 1
                    edge[s["last"] + 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                n.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int64()), pa.array(kept, pa.string())], ["key", "n_removed", "kept"])


def marked(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """What Marks.marks() gives of every row, written once: all later steps read the few columns that they need."""
    shape = "doc_id bigint, key bigint, raw bigint, n_words bigint, whole binary, anchor array<bigint>, at array<int>, again array<boolean>"
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("raw"))
    return written(own.mapInArrow(Marks(width, gram).marks, shape), "marks")


def repeated(docs: DataFrame, marks: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(key, n_removed, kept) of every distinct text that has repeated windows within other texts or itself.

    ``marks`` is marked() of the same rows.
    """
    work = Marks(width, gram)
    every = marks.select("key", F.explode(F.arrays_zip("anchor", "at", "again")).alias("x")).select("key", "x.*")
    counted = every.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("again").alias("again"), F.count(F.lit(1)).alias("n"))
    shards = F.ceil(F.col("n") / hot).cast("int").alias("shards")
    counted = written(counted.filter("a != b or again").select("anchor", shards), "anchors")
    mine = every.select("anchor", "key", "at").join(counted, "anchor").groupBy("key").agg(F.collect_set(F.struct("at", "shards")).alias("own"))
    mine = mine.select("key", F.col("own.at").alias("ats"), F.col("own.shards").alias("shards"))
    # one text of each key, found by the hash of the raw text; texts without a wanted key stay where they are
    chosen = marks.groupBy("key").agg(F.min("raw").alias("raw")).join(mine, "key")
    keyed = docs.select(F.xxhash64("text").alias("raw"), "text").join(written(chosen, "chosen"), "raw")
    wanted = written(keyed.dropDuplicates(["raw"]).select("key", "text", "ats", "shards"), "wanted")
    windows = wanted.filter(F.exists("shards", lambda n: n > 1)).mapInArrow(work.hot_windows, "anchor bigint, window bigint")
    windows = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    several = counted.filter("shards > 1").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    shape = "anchor bigint, shard int, key bigint, start int, words string, hot boolean, window bigint"
    confirmed = windows.join(several, "anchor").select("anchor", "shard", *[F.lit(None).cast(t).alias(c) for c, t in (("key", "bigint"), ("start", "int"), ("words", "string"), ("hot", "boolean"))], "window")
    dealt = wanted.mapInArrow(work.segments, shape).unionByName(confirmed)
    dealt = dealt.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", F.col("words").isNotNull())
    located = dealt.mapInArrow(work.locate, "key bigint, first int, last int")
    spans = located.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return wanted.select("key", "text").join(spans, "key").mapInArrow(work.cut, "key bigint, n_removed bigint, kept string")


def digests(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    Null and empty texts have no words. Texts shorter than a window stay. Rows with the same words, of whatever
    doc_id, get the same result.
    """
    own = marked(docs, width, gram)
    copies = own.filter(F.col("n_words") >= width).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_removed"))
    copies = copies.filter("n > 1").select("key", "n_removed", F.sha2(F.lit(""), 256).alias("kept_sha256"))
    parts = repeated(docs, own, width, gram, hot).select("key", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    # a text with copies is removed whole, which is the larger number
    best = copies.unionByName(parts).groupBy("key").agg(F.max(F.struct("n_removed", "kept_sha256")).alias("best"))
    best = written(best.select("key", "best.*"), "results")
    return own.join(best, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("kept_sha256", F.lower(F.hex("whole"))).alias("kept_sha256"),
    )
