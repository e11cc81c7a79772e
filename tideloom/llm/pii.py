"""Personal data: fixed forms, and identifiers that bootstrapped contexts discover.

Matches of the fixed forms are seeds. The words around them are lexical patterns; every identifier-like
token of the corpus (the seeds among them) is an instance. A pattern scores by the confidence of its instances, an
instance by its best pattern, in a few rounds over the graph of both. Patterns with a high score
then mark the other instances they stand beside, unseen by any fixed form; these are seeds of the next step, until
a step finds no more.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import put_back, set_aside, slices, texts, written

KINDS = ("email", "ip", "card", "phone")  # fixed order of ties
LEARNT = "context"  # the kind of a discovered span; ordered after the others
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits, nor ends in one; so the run can be taken whole
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "\"'`()[]{}<>.,;:!?*#$%&|=+-"  # taken off the ends of a token
REACH = 64  # characters on each side that are looked at first; more, until the words of a context are whole
REFUSED = "refused"  # the kind of an instance that has a fixed form but fails its check
# learning
ROUNDS = 3  # of a step
PRIOR = 1.0  # instances without confidence that every pattern starts with
SUPPORT = 5  # distinct seeds, or instances discovered in an earlier step, that a pattern needs
CONFIDENT = 0.8

SPANS = "array<struct<kind:string,start:int,end:int>>"
INSTANCES = "array<struct<start:int,end:int,instance:string,kind:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[str, int, int]]:
    """Each at sign with the longest local part before it and a domain after it, from left to right."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    return found


def forms(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the fixed forms, by start and then kind, and (start, end) of those that their check refused.

    Code points, end exclusive. A run of digits of another length than a card's is no card, so it isn't refused.
    """
    found, refused = emails(text) if "@" in text else [], []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
            else:
                refused.append(m.span())
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19:
                if luhn(digits):
                    found.append(("card", *m.span()))
                else:
                    refused.append(m.span())
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
            else:
                refused.append(m.span())
        found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found, sorted(refused)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed forms, by start and then kind; code points, end exclusive."""
    return forms(text)[0]


def _plain(words: list[str]) -> list[str]:
    """Words without punctuation at their ends, digits as 0; what is only punctuation is no word."""
    return [DIGIT.sub("0", x) for w in words if (x := w.strip(EDGE).lower())]


def _before(text: str, start: int, n: int) -> list[str]:
    """The last ``n`` words before a place, fewer at the start of the text; none is cut."""
    reach = REACH
    while True:
        at = max(0, start - reach)
        own = text[at:start].split()
        if at and own and not text[at].isspace():
            own = own[1:]  # it may have begun before
        words = _plain(own)
        if len(words) >= n or not at:
            return words[-n:]
        reach *= 4


def _after(text: str, end: int) -> list[str]:
    """The first word after a place, whole."""
    reach = REACH
    while True:
        own = text[end : end + reach].split()
        if end + reach < len(text) and own and not text[end + reach - 1].isspace():
            own = own[:-1]
        words = _plain(own)
        if words or end + reach >= len(text):
            return words[:1]
        reach *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span: two and three words before it, the words on both sides, and the key of an assignment.

    Words have letters or digits; punctuation between them is left out, but for = and : right before the span, which make
    the word before them a key: ``key = _``.
    """
    left, right = _before(text, start, 3), _after(text, end)
    out = [f"{' '.join(left[-n:])} _" for n in (2, 3) if len(left) >= n]
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    sign = text[max(0, start - 8) : start].rstrip(" \"'`([{<")[-1:]
    if left and sign and sign in "=:":
        out.append(f"{left[-1]} = _")
    return out


def instances(text: str, base: list[tuple[str, int, int]], refused: list[tuple[int, int]] = ()) -> list[tuple]:
    """Identifier-like strings: the seeds, and other tokens of six or more characters with four or more digits.

    A token that a fixed form has refused is of the kind REFUSED: it speaks against its patterns and is never discovered.
    """
    out = [(s, e, text[s:e].lower(), kind, contexts(text, s, e)) for kind, s, e in base]
    if not DIGIT.search(text):
        return out
    taken, at, bad = sorted((s, e) for _, s, e in base), 0, 0
    for m in TOKEN.finditer(text):
        token = m[0]
        if len(token) < 6 or sum("0" <= c <= "9" for c in token) < 4:
            continue
        start = m.start() + len(token) - len(token.lstrip(EDGE))
        end = m.end() - len(token) + len(token.rstrip(EDGE))
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        while bad < len(refused) and refused[bad][1] <= m.start():
            bad += 1
        if end - start >= 6 and not any(s < m.end() for s, _ in taken[at : at + 1]):
            kind = REFUSED if any(s < m.end() for s, _ in refused[bad : bad + 1]) else None
            out.append((start, end, text[start:end].lower(), kind, contexts(text, start, end)))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with the base spans of each whole text in _base and its instances in _found.

    Other columns mustn't have these names: see common.set_aside().
    """
    schema = docs.withColumns({"_base": F.lit(None).cast(SPANS), "_found": F.lit(None).cast(INSTANCES)}).schema
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("kind", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches):
        for b in slices(batches, 500):
            own = texts(b.column("text"))
            both = [forms(t) for t in own]
            base = [s for s, _ in both]
            found = [instances(t, *x) for t, x in zip(own, both, strict=True)]
            named = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in base]
            seen = [[dict(zip(("start", "end", "instance", "kind", "patterns"), s, strict=True)) for s in x] for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(named, base_type), pa.array(seen, found_type)], [*b.schema.names, "_base", "_found"])

    return docs.mapInArrow(run, schema)


def learn(scanned: DataFrame, rounds: int = ROUNDS, confident: float = CONFIDENT, support: int = SUPPORT) -> DataFrame:
    """(pattern, score) of the patterns that are confident in the end.

    Score of a pattern: the summed confidence of its distinct instances over their number plus PRIOR. Confidence of
    an instance: 1 for a seed, else the score of its best pattern that has the support of enough sure instances. Sure are
    the seeds, and from step to step the instances that have become confident. All others start each step
    without confidence, so that a pattern can't raise its own score in ever more rounds. Refused instances never gain any.
    """
    each = scanned.select(F.explode("_found").alias("f")).select("f.instance", F.explode("f.patterns").alias("pattern"), F.coalesce(F.col("f.kind").isin(*KINDS), F.lit(False)).cast("int").alias("seed"), F.coalesce(F.col("f.kind") == REFUSED, F.lit(False)).alias("refused"))
    edges = written(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("refused").alias("refused")), "edges")
    known = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("sure")).withColumn("confidence", F.col("sure"))
    known, before = written(known, "instances"), None
    while True:
        n = known.filter("sure > 0").count()
        if n == before:
            return scores.filter(F.col("score") >= confident).select("pattern", "score")
        before = n
        for _ in range(rounds):
            scores = edges.select("pattern", "instance").join(known, "instance").groupBy("pattern").agg(
                F.count_if(F.col("sure") > 0).alias("support"), (F.sum("confidence") / (F.count(F.lit(1)) + PRIOR)).alias("score")
            )
            scores = written(scores.filter(F.col("support") >= support), "patterns")
            best = edges.filter("not refused").join(scores, "pattern").groupBy("instance").agg(F.max("score").alias("confidence"), F.lit(0.0).alias("sure"))
            both = best.unionByName(known.select("instance", F.col("sure").alias("confidence"), "sure"))
            known = written(both.groupBy("instance").agg(F.max("sure").alias("sure"), F.max("confidence").alias("confidence")), "instances")
        kept = F.when(F.col("confidence") >= confident, F.col("confidence")).otherwise(0.0)
        known = known.select("instance", kept.alias("sure"), kept.alias("confidence"))


def _ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    order = F.array(*[F.lit(k) for k in (*KINDS, LEARNT)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with the base spans in _base and all spans, discovered ones included, in _spans.

    Columns of other names than doc_id and text come through common.set_aside().

    Null texts count as empty. Rows are told apart by doc_id and a hash of the text, so repeated rows
    get the same spans. Only rows with an identifier that no fixed form has found go through a join.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    light = written(scan(keyed.select("doc_id", "_row", "text")).drop("text").filter(F.size("_found") > 0), "scan")
    patterns = written(learn(light), "patterns")
    open_ones = light.select("doc_id", "_row", F.explode("_found").alias("f")).filter("f.kind is null")
    each = open_ones.select("doc_id", "_row", "f.start", "f.end", F.explode("f.patterns").alias("pattern"))
    hits = written(each.join(patterns, "pattern").select("doc_id", "_row", "start", "end").distinct(), "hits")
    hits = hits.select("doc_id", "_row", F.struct(F.lit(LEARNT).alias("kind"), "start", "end").alias("s"))
    hits = written(hits.groupBy("doc_id", "_row").agg(F.collect_set("s").alias("_more")).withColumnsRenamed({"doc_id": "_id", "_row": "_key"}), "hits")
    scanned = scan(keyed)
    has_open = F.exists("_found", lambda f: f["kind"].isNull())
    plain = scanned.filter(~has_open).withColumn("_more", F.lit(None).cast(SPANS))
    rest = scanned.filter(has_open)
    rest = rest.join(hits, (rest["_row"] == hits["_key"]) & rest["doc_id"].eqNullSafe(hits["_id"]), "left").drop("_id", "_key")
    both = plain.unionByName(rest)
    spans = _ordered(F.concat("_base", F.coalesce("_more", F.array().cast(SPANS))))
    return both.withColumn("_spans", spans).drop("_row", "_found", "_more")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets; n_chars follows the text.

    Overlapping spans become one, named after the first. A null text stays null. All other columns pass unchanged,
    whatever their names; repeated rows stay.
    """

    def run(batches):
        for b in slices(batches, 500):
            new = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                parts, done = [], 0
                for s in spans or []:
                    if s["start"] >= done:
                        parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
                    done = max(done, s["end"])
                new.append(text if text is None else "".join([*parts, text[done:]]))
            yield b.set_column(b.schema.names.index("text"), "text", pa.array(new, pa.string())).select(names)

    own, now = set_aside(docs, "doc_id", "text")
    names = own.columns
    found = written(find(own).drop("_base"), "found")  # so that a task holds one Python worker, not that of the scan beside its own
    out = put_back(found.mapInArrow(run, own.schema), now)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans, for every row."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    found = find(docs.select("doc_id", "text"))
    return found.select("doc_id", *counts, F.sha2(shown(F.col("_base")), 256).alias("base_sha256"), shown(F.col("_spans")).alias("spans"))
