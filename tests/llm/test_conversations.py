import hashlib
import random
import zlib

import pytest

from tideloom.llm import conversations as cv

SHAPE = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, fault) rows: all ways forward, the least of each state."""

    def close(best):
        for _ in range(3):
            for q, (c, a, out) in list(best.items()):
                to = 3 if q == 2 else 2
                way = (c + 2, a + "I", (*out, "assistant:" if q == 2 else "user:"))
                best[to] = min(best.get(to, way), way)
        return best

    best = {0: (0, "", ())}
    for role, text, fault in rows:
        new = {}
        for q, (c, a, out) in close(best).items():
            ways = [(q, (c + 3, a + "D", out))]
            if fault not in ("blank", "duplicate"):
                cut, to = fault == "truncated", {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role[:1]))
                ways += [(to, (c + cut, a + "K", (*out, f"{role}:{text}")))] if to else []
                to = 3 if q == 2 else 2
                ways.append((to, (c + 2 + cut, a + "R", (*out, f"{'assistant' if to == 3 else 'user'}:{text}"))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = new
    best = close(best)
    return min(best[q] for q in (0, 3) if q in best)


def plain(rows):
    """What report() gives, conversation by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        told, seen = [], set()
        for _, role, text in own:
            body = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            told.append((role, text, fault))
            seen.add((role, text))
        cost, audit, lines = cheapest(told)
        turns = {t for t, *_ in own if t is not None}
        initials = [r[:1] for r, *_ in told]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[sum(f == x for *_, f in told) for x in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def conversations(rng):
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "System", "s", None])
            text = rng.choice(["Yes.", "No!", "Why?\n", "cut", "", " \t", None, "ünï .", "a. b", "Fine.\x0b"])
            rows += [(conv, rng.choice([turn, turn, turn, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("piece", [cv.PIECE, 3])
def test_report_as_defined(spark, monkeypatch, piece):
    monkeypatch.setattr(cv, "PIECE", piece)
    rows = conversations(random.Random(piece))
    got = cv.report(spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS own", "2 AS seg", "'x' AS fault"))
    got = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert got == plain(rows)


def test_tables_equal_single_steps():
    rng, t = random.Random(2), cv.tables()
    assert len(t.vectors) < 64 and all(min(v) == 0 for v in t.vectors)
    for _ in range(500):
        symbols = "".join(rng.choice(cv.SYMBOLS) for _ in range(rng.randint(0, 14)))
        costs = cv.END
        for s in reversed(symbols):
            costs = cv.step(s, costs)
        to, added = cv.lookups(symbols)
        assert tuple(c + int(added[0]) for c in t.vectors[to[0]]) == costs
        at = rng.randint(0, len(symbols))
        whole, _ = cv.traced(symbols, 0, cv.START, True)
        first, state = cv.traced(symbols[:at], int(cv.lookups(symbols[at:])[0][0]), cv.START, False)
        assert first + cv.traced(symbols[at:], 0, state, True)[0] == whole


def test_one_long_conversation_and_none(spark, monkeypatch):
    monkeypatch.setattr(cv, "PIECE", 100)
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant"]), f"text {rng.randint(0, 3000)}{rng.choice(['.', '!', ''])}") for i in range(4000)] + [(8, 0, "user", "word " * 40000)]
    got = {r.conv_id: tuple(r)[1:] for r in cv.report(spark.createDataFrame(rows, SHAPE)).collect()}
    assert got == plain(rows)
    assert cv.report(spark.createDataFrame([], SHAPE)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", " "), (1, 3, "tool", "It is 7."), (2, None, "user", "Cut of")]
    told = {1: [("system", "Be kind.", ""), ("assistant", "Hello.", ""), ("user", " ", "blank"), ("tool", "It is 7.", "")], 2: [("user", "Cut of", "truncated")]}
    after, found = cv.repair(spark.createDataFrame(rows, SHAPE))
    assert {r.conv_id: (r.cost, r.audit) for r in found.collect()} == {k: cheapest(v)[:2] for k, v in told.items()}
    want = {k: [tuple(line.split(":", 1)) for line in cheapest(v)[2]] for k, v in told.items()}
    got = {}
    for r in sorted(after.collect(), key=lambda r: (r.conv_id, r.seg, r.place)):
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {k: v for k, v in want.items() if v}
