"""Fill-in-middle transformation: documents cut at two ranks of an indexable skip list.

A text is a list of units: runs of letters, and every other character by itself. The skip list of its units has express lanes; each
link carries its width in units and in code points. A search goes down from the highest lane, along links as long as
their units don't pass the rank, and adds up the code points of those it takes: so a rank in units becomes a place in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put_back, set_aside, slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPREAD = 4  # a unit of a lane is in the next one once in SPREAD times
SEED = 12


class SkipList:
    """Links by lane, the lowest first: where each leads, and its width in units and code points.

    A lane starts at the head, place 0, which comes before the first unit. Link i of a lane leaves its node i; ``down`` is the
    place of that node in the lane below. Heights come from a generator of fixed seed, so that a text has one list.
    """

    def __init__(self, lengths: np.ndarray):
        self.units, self.points, self.down = [np.ones(len(lengths), np.int64)], [lengths.astype(np.int64)], [np.zeros(0, np.int64)]
        rng = np.random.default_rng(SEED)
        while len(self.units[-1]) > SPREAD:
            # node 0 is the head and in every lane, the end is none
            stay = np.concatenate(([0], 1 + np.flatnonzero(rng.random(len(self.units[-1]) - 1) * SPREAD < 1)))
            if len(stay) == len(self.units[-1]):
                break
            self.points.append(np.add.reduceat(self.points[-1], stay))
            self.units.append(np.add.reduceat(self.units[-1], stay))
            self.down.append(stay)

    def find(self, rank: int) -> int:
        """The code points before the unit of this rank; a rank of all units gives the length of the text."""
        at, points = 0, 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, widths = self.units[lane], self.points[lane]
            while at < len(units) and units[at] <= rank:
                rank, points, at = rank - int(units[at]), points + int(widths[at]), at + 1
            if rank == 0:
                return points
            at = int(self.down[lane][at]) if lane else at
        return points


def unit_lengths(text: str) -> np.ndarray:
    """The code points of each unit."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = ((c | 32) >= 97) & ((c | 32) <= 122) & (c < 128)
    starts = np.flatnonzero(~(letter & np.concatenate(([False], letter[:-1]))))
    return np.diff(np.concatenate((starts, [len(c)])))


def cuts(text: str, one: int, two: int) -> tuple[int, int, int]:
    """The number of units, and the two places in the text at the ranks ``one`` and ``two`` modulo that number plus 1, in order."""
    own = SkipList(unit_lengths(text))
    n = len(own.units[0])
    first, second = sorted((one % (n + 1), two % (n + 1)))
    return n, own.find(first), own.find(second)


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    Per hundred, ``plain`` documents stay as they are and ``spm`` of the others put the suffix first. Empty texts and those
    that hold a marker stay as well; null counts as empty. Choices come from sha256 of ``seed:doc_id``; a row without doc_id has
    the empty text there. Repeated rows give repeated results; other columns pass, those named like the new ones are replaced.
    """
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    own, now = set_aside(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    holds = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | text.contains(m)
    form = F.when((text == "") | holds | (h[2] % 100 >= 100 - plain), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    own = own.withColumns({"form": form, "one": h[0], "two": h[1]})
    new = {"n": "bigint", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}

    def run(batches):
        for b in slices(batches, 300):
            out = []
            for t, f, one, two in zip(texts(b.column("text")), *[b.column(c).to_pylist() for c in ("form", "one", "two")], strict=True):
                n, i, j = cuts(t, one, two)
                if f == "plain":
                    out.append((n, None, None, t))
                else:
                    parts = (PREFIX, t[:i], SUFFIX, t[j:], MIDDLE, t[i:j]) if f == "psm" else (SUFFIX, t[j:], PREFIX, t[:i], MIDDLE, t[i:j])
                    out.append((n, i, j - i, "".join(parts)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [*b.schema.names, *new])

    shape = own.withColumns({k: F.lit(None).cast(t) for k, t in new.items()}).schema
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    return put_back(own.mapInArrow(run, shape), {c: n for c, n in now.items() if c not in names}, *names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from: markers can't occur in its parts, nor across their ends."""
    to = lambda s, start, end: F.substring(s, start, F.greatest(end - start, F.lit(0)))
    size = F.char_length(output) + 1
    at = {m: F.instr(output, m) for m in (PREFIX, SUFFIX, MIDDLE)}
    middle = to(output, at[MIDDLE] + 3, size)
    psm = F.concat(to(output, F.lit(4), at[SUFFIX]), middle, to(output, at[SUFFIX] + 3, at[MIDDLE]))
    spm = F.concat(to(output, at[PREFIX] + 3, at[MIDDLE]), middle, to(output, F.lit(4), at[PREFIX]))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text restored from it."""
    out = transform(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
