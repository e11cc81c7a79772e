"""Conversation structure repair: Four-Russians block tables over the turns of each conversation.

A row is one of nine symbols: what its role begins with, whether it is cut off, or that it has to go. The cheapest repair from a place on
is a vector of four costs, one for each state of the grammar ``(s?(ua)+)?``; less its minimum it is one of a few dozen. So the step over
any BLOCK symbols is a table: vector after the block and symbols in, vector before it and cost out.

(1) Rows are dealt by ranges of (conversation, turn), so a conversation of any length becomes pieces of bounded size. (2) Each
piece looks its blocks up for every vector that may follow it: a function of a few dozen numbers. (3) The functions of a
conversation are applied from its last piece to the first. (4) With the vector after it known, every piece is expanded, block by
block backward, and traced forward from each state; equal costs go to the smallest letter. (5) The states of the pieces are
chained from the first to the last.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once_per_worker, slices, written

SPACE = " \t\n\v\f\r"
BLOCK = 4  # symbols of a block: 9^4 blocks
PIECE = 20000  # rows of a piece at most
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what was put out last
SYMBOLS = "XsuaoSUAO"  # has to go; whole rows by initial, o for any other; the same cut off
ROLE = {USER: "user", ASSISTANT: "assistant"}
TURN_TO = (USER, USER, ASSISTANT, USER)  # what a state needs next
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
DELETED, INSERTED, REROLED, CUT = 3, 2, 2, 1  # costs
NEVER = 1 << 20


def inserts(costs: tuple) -> tuple:
    """The cheapest costs where rows may be inserted first: two at most, since a third would come back to a state."""
    for _ in range(2):
        costs = tuple(min(c, INSERTED + costs[TURN_TO[q]]) for q, c in enumerate(costs))
    return costs


def moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of what may be done with a row, by letter."""
    out = [("D", state, DELETED)]
    if symbol != "X":
        cut = CUT if symbol.isupper() else 0
        kept = KEEP[symbol.lower()].get(state)
        out += [] if kept is None else [("K", kept, cut)]
        out.append(("R", TURN_TO[state], REROLED + cut))
    return out


def step(symbol: str, after: tuple) -> tuple:
    """The costs before a row from those after it."""
    return inserts(tuple(min(cost + after[to] for _, to, cost in moves(symbol, q)) for q in range(4)))


END = inserts((0, NEVER, NEVER, 0))


@dataclass
class Tables:
    """vectors by number (0 is the end), their numbers, and for 1 and BLOCK symbols: vector before and cost added, by block and vector."""

    vectors: list[tuple]
    number: dict[tuple, int]
    one: tuple[np.ndarray, np.ndarray]
    block: tuple[np.ndarray, np.ndarray]


def make_tables() -> Tables:
    vectors, number, to, add = [END], {END: 0}, [], []
    for v in vectors:  # grows
        row = []
        for s in SYMBOLS:
            new = step(s, v)
            low = min(new)
            new = tuple(c - low for c in new)
            if new not in number:
                number[new] = len(vectors)
                vectors.append(new)
            row.append((number[new], low))
        to.append([x for x, _ in row])
        add.append([x for _, x in row])
    one = np.array(to, np.int16).T, np.array(add, np.int32).T

    def longer(block, _):
        """One symbol more in front of the blocks."""
        to, add = block
        return one[0][:, to].reshape(-1, len(vectors)), (one[1][:, to] + add).reshape(-1, len(vectors))

    return Tables(vectors, number, one, reduce(longer, range(BLOCK - 1), one))


def tables() -> Tables:
    return once_per_worker("conversation tables", make_tables)


def coded(symbols: str) -> np.ndarray:
    return np.array([SYMBOLS.index(c) for c in symbols], np.int64)


def lookups(symbols: str) -> tuple[np.ndarray, np.ndarray]:
    """For every vector after ``symbols``: the vector before them, and the cost added."""
    t, code = tables(), coded(symbols)
    lead = len(code) % BLOCK
    to, add = np.arange(len(t.vectors)), np.zeros(len(t.vectors), np.int64)
    for b in (code[lead:].reshape(-1, BLOCK) @ len(SYMBOLS) ** np.arange(BLOCK)[::-1])[::-1]:
        to, add = t.block[0][b, to], add + t.block[1][b, to]
    for c in code[:lead][::-1]:
        to, add = t.one[0][c, to], add + t.one[1][c, to]
    return to, add


def boundaries(symbols: str, after: int) -> list[int]:
    """The vectors before every block and after the last one."""
    t, code = tables(), coded(symbols)
    lead, out = len(code) % BLOCK, [after]
    for b in (code[lead:].reshape(-1, BLOCK) @ len(SYMBOLS) ** np.arange(BLOCK)[::-1])[::-1].tolist():
        out.append(int(t.block[0][b, out[-1]]))
    return out[::-1]


def traced(symbols: str, after: int, state: int, last: bool) -> tuple[str, int]:
    """The least letters of a cheapest repair from a state before ``symbols``, and the state after them.

    Rows are inserted before the row that follows them; at the end of a conversation (``last``) also after its last one.
    """
    t, lead, letters = tables(), len(symbols) % BLOCK, []
    cuts = [symbols[:lead], *(symbols[i : i + BLOCK] for i in range(lead, len(symbols), BLOCK))] if lead else [symbols[i : i + BLOCK] for i in range(0, len(symbols), BLOCK)]
    ends = boundaries(symbols, after)
    for block, end in zip(cuts, ends[len(ends) - len(cuts) :], strict=True):
        costs = [t.vectors[end]]
        for s in reversed(block):  # the expanded block: costs before each of its rows
            costs.append(step(s, costs[-1]))
        costs.reverse()
        for i, s in enumerate(block):
            while True:
                options = [(letter, to) for letter, to, cost in moves(s, state) if cost + costs[i + 1][to] == costs[i][state]]
                if INSERTED + costs[i][TURN_TO[state]] == costs[i][state]:
                    options.append(("I", TURN_TO[state]))
                letter, state = min(options)
                letters.append(letter)
                if letter != "I":
                    break
    while last and state not in (START, ASSISTANT):
        letters.append("I")
        state = TURN_TO[state]
    return "".join(letters), state


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equal values of these columns, null like null."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, blank, truncated, later): later tells that an earlier turn had the same role and text."""
    seen = rows.groupBy("conv_id", F.xxhash64("role", "text").alias("own")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"), F.count(F.lit(1)).alias("n"))
    seen = written(seen.filter("n > 1").select("conv_id", "own", "first"), "seen")
    rows = rows.withColumn("own", F.xxhash64("role", "text"))
    body = F.rtrim("text", F.lit(SPACE))
    return rows.join(seen, same(rows, seen, "conv_id", "own"), "left").select(
        rows["conv_id"], "turn", "role", "text",
        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.coalesce(F.struct(F.col("turn").isNotNull().alias("some"), "turn") > F.col("first"), F.lit(False)).alias("later"),
    )


def in_pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, seg, at, turn, role, text, fault, initial, symbol) of faults(): pieces of a conversation in its order.

    Rows are sorted by conversation, turn (nulls first), role and text; equal rows lie side by side in one task.
    """

    def run(batches):
        task, before, seg, at = TaskContext.get().partitionId(), None, -1, 0
        for b in slices(batches, 1000):
            cols = [b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "blank", "truncated", "later")]
            out = []
            for conv, turn, role, text, blank, truncated, later in zip(*cols, strict=True):
                fault = "blank" if blank else "duplicate" if later or before == (conv, turn, role, text) else "truncated" if truncated else ""
                if before is None or before[0] != conv or at >= PIECE:
                    seg, at = seg + 1, 0
                before, initial = (conv, turn, role, text), role[:1] if role[:1] in ("s", "u", "a") else "o"
                out.append(((task << 40) + seg, at, fault, initial, "X" if fault in ("blank", "duplicate") else initial.upper() if fault else initial))
                at += 1
            more = list(zip(*out, strict=True)) if out else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *[pa.array(c, t) for c, t in zip(more, types, strict=True)]], [*b.schema.names[:4], "seg", "at", "fault", "initial", "symbol"])

    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    shape = "conv_id bigint, turn bigint, role string, text string, seg bigint, at int, fault string, initial string, symbol string"
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, shape), "turns")


def piece_functions(turns: DataFrame) -> DataFrame:
    """(conv_id, seg, symbols, initials, to, added) of every piece."""
    own = turns.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("at", "symbol", "initial"))).alias("own"))
    own = own.select("conv_id", "seg", F.array_join("own.symbol", "").alias("symbols"), F.array_join("own.initial", "").alias("initials"))

    def run(batches):
        for b in slices(batches, 500):
            found = [lookups(s) for s in b.column("symbols").to_pylist()]
            lists = [pa.array([f[k].tolist() for f in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "to", "added"])

    return written(own.mapInArrow(run, "conv_id bigint, seg bigint, symbols string, initials string, to array<bigint>, added array<bigint>"), "pieces")


def backward(pieces: DataFrame) -> DataFrame:
    """(conv_id, seg, after, last, cost, illegal): the vector after each piece; cost and illegal pairs from the piece on."""

    def run(batches):
        conv, now, total, illegal, first = (), 0, 0, 0, ""
        for b in batches:
            out = []
            cols = [b.column(n).to_pylist() for n in ("conv_id", "initials", "to", "added")]
            for own, initials, to, added in zip(*cols, strict=True):
                last = (own,) != conv
                if last:
                    conv, now, total, illegal, first = (own,), 0, 0, 0, ""
                after, line = now, initials + first
                total, now, first = total + added[now], to[now], line[0]
                illegal += sum(line[i : i + 2] not in ("su", "ua", "au") for i in range(len(line) - 1))
                out.append((after, last, total + tables().vectors[now][START], illegal))
            more = list(zip(*out, strict=True)) if out else [[]] * 4
            types = (pa.int32(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), *[pa.array(c, t) for c, t in zip(more, types, strict=True)]], ["conv_id", "seg", "after", "last", "cost", "illegal"])

    light = pieces.select("conv_id", "seg", "initials", "to", "added").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg"))
    return written(light.mapInArrow(run, "conv_id bigint, seg bigint, after int, last boolean, cost bigint, illegal bigint"), "after")


def expanded(pieces: DataFrame, after: DataFrame) -> DataFrame:
    """(conv_id, seg, state, audit) of every piece: the state before it and its letters."""

    def trace(batches):
        for b in slices(batches, 500):
            cols = [b.column(n).to_pylist() for n in ("symbols", "after", "last")]
            found = [[traced(s, a, q, last) for q in range(4)] for s, a, last in zip(*cols, strict=True)]
            letters = pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string()))
            ends = pa.array([[x for _, x in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), letters, ends], ["conv_id", "seg", "letters", "ends"])

    def chain(batches):
        conv, state = (), START
        for b in batches:
            out = []
            for own, letters, ends in zip(*[b.column(n).to_pylist() for n in ("conv_id", "letters", "ends")], strict=True):
                if (own,) != conv:
                    conv, state = (own,), START
                out.append((state, letters[state]))
                state = ends[state]
            more = list(zip(*out, strict=True)) if out else [[]] * 2
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("seg"), pa.array(more[0], pa.int32()), pa.array(more[1], pa.string())], ["conv_id", "seg", "state", "audit"])

    both = pieces.join(after, same(pieces, after, "conv_id", "seg")).select(pieces["conv_id"], pieces["seg"], "symbols", "after", "last")
    four = both.mapInArrow(trace, "conv_id bigint, seg bigint, letters array<string>, ends array<int>")
    four = four.repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return written(four.mapInArrow(chain, "conv_id bigint, seg bigint, state int, audit string"), "audits")


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, seg, place, role, text, edit): the rows of the repaired conversations, by seg and place within each."""

    def run(batches):
        now, letters, state, place = None, iter(""), START, 0
        held = []

        def put(role, text, edit):
            nonlocal place, state
            held.append((*now, place, role, text, edit))
            place, state = place + 1, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

        def insert():
            put(ROLE[TURN_TO[state]], "", "I")

        def flush():
            cols = list(zip(*held, strict=True)) if held else [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "seg", "place", "role", "text", "edit"])

        for b in slices(batches, 1000):
            cols = [b.column(n).to_pylist() for n in ("conv_id", "seg", "role", "text", "state", "audit")]
            for conv, seg, role, text, first, audit in zip(*cols, strict=True):
                if now != (conv, seg):
                    for _ in letters:  # rows inserted at the end of the piece before
                        insert()
                    now, letters, state, place = (conv, seg), iter(audit), first, 0
                letter = next(letters)
                while letter == "I":
                    insert()
                    letter = next(letters)
                if letter != "D":
                    put(role if letter == "K" else ROLE[TURN_TO[state]], text, letter)
            yield flush()
        for _ in letters:
            insert()
        yield flush()

    both = turns.join(audits, same(turns, audits, "conv_id", "seg")).select(turns["conv_id"], turns["seg"], "at", "role", "text", "state", "audit")
    both = both.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "at")
    return both.mapInArrow(run, "conv_id bigint, seg bigint, place int, role string, text string, edit string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired(): the digest is sequential, so the rows of a conversation run through one task, unheld."""

    def run(batches):
        conv, own = (), None
        for b in slices(batches, 1000):
            out = []
            for key, role, text in zip(*[b.column(n).to_pylist() for n in ("conv_id", "role", "text")], strict=True):
                if (key,) != conv:
                    if own:
                        out.append((conv[0], own.hexdigest()))
                    conv, own = (key,), hashlib.sha256()
                else:
                    own.update(b"\n")
                own.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield batch(out)
        yield batch([(conv[0], own.hexdigest())] if own else [])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["conv_id", "repaired_sha256"])

    ordered = rows.select("conv_id", "seg", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "place")
    return ordered.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def whole(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of ``rows``; a null role or text is one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` as whole() gives them, with faults put in by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = whole(rows).withColumn("_kind", F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20).filter("_kind != 0")
    out = out.withColumn("text", F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows, as repaired() gives them, and one row of each conversation with its gaps, faults, cost and audit.

    ``rows`` has conv_id, turn, role and text; nulls in role and text are one space, rows without conv_id are one conversation.
    Rows of equal turn are taken by role and text. Repeated rows are duplicates. No rows give no conversations.
    """
    turns = in_pieces(faults(whole(rows)))
    pieces = piece_functions(turns)
    after = backward(pieces)
    audits = expanded(pieces, after)
    found = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    cost = after.groupBy("conv_id").agg(F.min_by("illegal", "seg").alias("illegal"), F.min_by("cost", "seg").alias("cost"))
    letters = audits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "audit"))).alias("own")).select("conv_id", F.array_join("own.audit", "").alias("audit"))
    found, cost, letters = written(found, "found"), written(cost, "cost"), written(letters, "letters")
    both = found.join(cost, same(found, cost, "conv_id")).drop(cost["conv_id"])
    both = both.join(letters, same(both, letters, "conv_id")).drop(letters["conv_id"])
    return repaired(turns, audits), both


def report(rows: DataFrame) -> DataFrame:
    """One row of every conversation of ``rows`` after damage and repair, with the digest of its repaired rows.

    A conversation without rows after damage has zeros, an empty audit and the digest of the empty text, as has one that is
    repaired by deleting all of its rows, but for its counts and cost.
    """
    after, found = repair(damaged(rows))
    named = written(rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct(), "names")
    hashes = written(digests(after), "digests")
    out = named.join(found, same(named, found, "conv_id"), "left").drop(found["conv_id"])
    out = out.join(hashes, same(out, hashes, "conv_id"), "left").drop(hashes["conv_id"])
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
