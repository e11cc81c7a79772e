import hashlib
import random
import re

from pyspark.sql import functions as F

from tideloom.llm import infill


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    i, j = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_ranks_of_the_skip_list():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "C", " ", "é", "7", "\n", "\U0001f600", "K", "["]) for _ in range(rng.randint(0, 90)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        own = infill.SkipList(infill.unit_lengths(text))
        assert [own.find(r) for r in range(len(units) + 1)] == [len("".join(units[:r])) for r in range(len(units) + 1)]
        for lane in range(1, len(own.units)):
            assert len(own.units[lane]) < len(own.units[lane - 1]) and own.units[lane].sum() == len(units) and own.points[lane].sum() == len(text)


def rows_of(rng):
    parts = ["word", " ", "<", "<S", "S>", ">", "\n", "ü", "\U0001f600", "P>", "M", "x1"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    return [*rows, (None, "no id here"), (None, None), (900, None), (901, ""), (902, "has <M> in it"), (903, "long words " * 30000), (3, "again"), (3, "again")]


def test_report_and_restored_text(spark, docs_of):
    rows = rows_of(random.Random(2))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted([(*x[:5], sha(x[5]), sha(t or "")) for x, t in ((plain(*r), r[1]) for r in rows)], key=str)
    got = infill.report(docs_of(rows).withColumn("one", F.lit(1)).withColumn("form", F.lit("clash")))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert infill.report(docs_of([])).count() == 0


def test_transform_keeps_other_columns(spark, docs_of):
    docs = docs_of([(1, "some words to cut"), (2, None)]).withColumns({"one": F.lit("mine"), "output": F.lit("old"), "aside_0": F.lit(3)})
    out = infill.transform(docs)
    assert out.columns == [*[c for c in docs.columns if c != "output"], "n", "form", "prefix_chars", "middle_chars", "output"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].one == "mine" and got[1].aside_0 == 3 and got[1].output == plain(1, "some words to cut")[5] and got[2].output == ""
