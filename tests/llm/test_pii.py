import hashlib
import random
import re

from pyspark.sql import functions as F

from tideloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                double = [d if j % 2 == 0 else sum(map(int, str(2 * d))) for j, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(double) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), i, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_as_defined():
    rng = random.Random(8)
    parts = ["a.b@c-d.e.f", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713",
             "+49", "é", " ", "\n", "a@b.c@d.e", "..", "-", "000255.0.0.1", "00000000000000", "12345678901234567890", "+1.2.3.4.5.6.7.8.9.0", "%+_@z.z.", "٣"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("1" * 200000) == [] and pii.base_spans("a" * 200000 + "@") == []


def test_contexts_discover_identifiers(spark, docs_of):
    seeds = [(i, f"name word{i} please call client number +1 ({200 + i}) 555-{1000 + i} soon") for i in range(20)]
    unseen = [(100, "more words please call client number 77-12345-99 today"), (101, "the weather of 2024-01-05 was fine"), (102, "no digits at all")]
    got = {r.doc_id: r for r in pii.report(docs_of(seeds + unseen)).collect()}
    text = dict(unseen)[100]
    at = text.index("77-")
    assert got[100].spans == f"context:{at}:{at + 11}"
    assert got[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[101].spans == got[102].spans == ""
    assert all(got[i].n_phone == 1 for i in range(20))


def test_edges_and_redaction(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "mail a@b.cd now"), (4, "mail a@b.cd now"), (4, "mail a@b.cd now"), (5, "x " * 50000 + "1.2.3.4")]
    docs = docs_of(rows).withColumn("_base", F.lit("clash")).withColumn("_spans", F.lit(1)).withColumn("start", F.lit(2))
    got = pii.report(docs).collect()
    assert len(got) == len(rows)
    for r, text in ((r, dict(rows)[r.doc_id]) for r in got):
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(text or ""))
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    clean = pii.redact(docs_of(rows)).collect()
    assert sorted(r.text or "" for r in clean)[-2:] == sorted(["mail [EMAIL] now", "x " * 50000 + "[IP]"])[-2:]
    assert next(r.text for r in clean if r.doc_id == 1) is None
    assert pii.report(docs_of([])).count() == 0


def test_discovered_identifiers_discover_others(spark, docs_of):
    # the client numbers are learnt beside phones, and recur after words that no fixed form follows
    rows = [(i, f"word{i} please call client number +1 ({200 + i}) 555-{1000 + i} soon") for i in range(80)]
    rows += [(100 + i, f"more words please call client number 77-1{i:02}45-99 today") for i in range(12)]
    rows += [(200 + i, f"shown at the desk passport no. 77-1{i:02}45-99 then") for i in range(12)]
    rows += [(300, "shown at the desk passport no. 88-54321-00 then"), (301, "the order of 2024-01-05 was fine")]
    got = {r.doc_id: r.spans for r in pii.report(docs_of(rows)).collect()}
    at = dict(rows)[300].index("88-")
    assert got[300] == f"context:{at}:{at + 11}" and got[301] == ""
    assert all(got[i].startswith("context:") for i in [*range(100, 112), *range(200, 212)])


def test_planted_identifiers_by_recall_and_precision(spark, docs_of):
    rng = random.Random(9)
    words = ["the", "quick", "report", "on", "many", "things", "came", "late", "today"]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    code = lambda: f"{rng.choice('ABCDEF')}{rng.randrange(10**6, 10**7)}-{rng.choice('XYZ')}"
    rows, planted = [], {}
    for i in range(200):
        phone, mail, secret = f"+1 ({200 + i}) 555-{1000 + i}", f"user{i}@mail{i % 7}.example.com", f"{rng.getrandbits(160):040x}"
        own = code()
        # a key that also holds addresses; a phrase that also holds phones; and a phrase met only beside what these two discover
        lines = f'contact = "{mail}"', f'contact = "{secret}"', f"client number {phone}", f"client number {own}", f"client number {own} for passport no. {own}", f"passport no. {code()}"
        line = rng.choices(lines, (3, 1, 5, 1, 2, 1))[0]
        rows.append((i, f"{noise(6)} {line} {noise(4)} in 2024-{rng.randrange(10, 99)}-{rng.randrange(10, 99)} {noise(3)} {'version 999.1.1.' + str(i) if i % 5 == 0 else ''}"))
        found = {m for m in (secret, own) if m in line} | set(re.findall(r"passport no\. (\S+)", line))
        planted[i] = {(m.start(), m.end()) for f in found for m in re.finditer(re.escape(f), rows[-1][1])}
    got = {}
    for r in pii.report(docs_of(rows)).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        got[r.doc_id] = {(int(s), int(e)) for kind, s, e in spans if kind == "context"}
    right = sum(len(got[i] & planted[i]) for i in planted)
    assert right / sum(map(len, planted.values())) > 0.95 and right / sum(map(len, got.values())) > 0.95


def test_contexts_are_whole_words():
    text = "x" * 500 + "word " + " " * 300 + "= -- next: <<1234567>> ... " + "y" * 400 + " z"
    at = text.index("1234567")
    assert pii.contexts(text, at, at + 7) == ["x" * 500 + "word next _", "next _ " + "y" * 400, "next = _"]
    assert pii.contexts("1234567", 0, 7) == []


def test_refused_forms_are_never_discovered(spark, docs_of):
    rows = [(i, f"pay by card 4111 1111 1111 1111 or account 4111-1111-1111-{1112 + i}") for i in range(3)]
    rows += [(10 + i, f"the account 00-{i}234-56-{i} and account a{i}@b.cd") for i in range(9)]
    got = {r.doc_id: r.spans for r in pii.report(docs_of(rows)).collect()}
    assert all(got[i] == "card:12:31" for i in range(3))


def test_redaction_keeps_columns_of_any_name(spark, docs_of):
    names = ["_base", "_row", "_found", "_spans", "_more", "_id", "_key"]
    docs = docs_of([(1, "mail a@b.cd now"), (2, None)]).withColumns({n: F.lit(n) for n in names})
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert got[1].text == "mail [EMAIL] now" and got[2].text is None
    assert all(r[n] == n for r in got.values() for n in names)
