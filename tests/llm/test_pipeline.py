"""The pipeline against plain versions of its stages, over whole small tables."""

import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tideloom.llm import pii, quality, simhash
from tideloom.llm.queries import PIECES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after every stage, the documents first."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], DIR), name))
    return [df.collect() for df in out], [df.columns for df in out]


def test_columns_and_order(stages):
    rows, columns = stages
    assert all(c == columns[0] for c in columns[:5]) and columns[5][: len(columns[0])] == columns[0]
    assert len(rows[1]) > len(rows[2]) > len(rows[3]) == len(rows[4]) == len(rows[5])


def test_quality(spark, stages):
    rows, _ = stages
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.predictions(spark.read.parquet(f"{DIR}/documents.parquet"), labels).collect()}
    assert {r.doc_id for r in rows[1]} == {i for i, s in scores.items() if s >= 0.3}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    right = [(r.doc_id in {x.doc_id for x in rows[1]}) == bool(marked[r.doc_id]) for r in rows[0] if r.doc_id in marked]
    assert sum(right) / len(right) > 0.95


def test_near_copies(stages):
    rows, _ = stages
    prints = {r.doc_id: simhash.fingerprint(r.text or "", 4, 42) for r in rows[1]}
    up = {i: i for i in prints}

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in prints:
        for j in prints:
            if i < j and ((prints[i] ^ prints[j]) % 2**64).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {r.doc_id for r in rows[2]} == {i for i in up if up[i] == i}


def test_benchmark(spark, stages):
    rows, _ = stages
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in rows[2] if not any(f" {i} " in f" {plain(r.text)} " for i in items)}
    assert {r.doc_id for r in rows[3]} == clean


def test_personal_data_and_tokens(stages):
    rows, _ = stages
    before = {r.doc_id: r.text for r in rows[3]}
    for r in rows[4]:
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text)
        if not pii.base_spans(before[r.doc_id]) and "[CONTEXT]" not in r.text:
            assert r.text == before[r.doc_id]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in rows[5]:
        assert list(r.ids) == library.encode(r.text) and r.decoded == library.decode(list(r.ids))


def test_run_gives_the_same(spark, stages):
    rows, _ = stages
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()) == sorted(r.doc_id for r in rows[5])


@pytest.mark.parametrize("at", range(5))
def test_stages_take_any_rows(spark, at):
    """Nulls, empty and very long texts, repeated rows, no rows at all, and columns named like those that stages use within."""
    name, stage = corpus_pipeline.STAGES[at]
    rows = [(1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (None, "mail a@b.cd now"), (None, None), (4, "long words " * 40000)]
    clash = ("_score", "_base", "_row", "_found", "_spans", "_more", "_id", "_key", "_print", "stats", "row", "first", "seeds", "uid", "start", "ids_", "aside_0")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs = docs.withColumns({c: F.lit(7.0) for c in clash})
    out = stage(spark, docs, DIR)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    assert all(r[c] == 7.0 for r in got for c in clash)
    texts = [(r.doc_id, r.text) for r in got]
    if name in ("benchmark_decontamination", "sentencepiece"):
        assert sorted(texts, key=str) == sorted(rows, key=str)
    elif name == "pii":
        assert sorted(texts, key=str) == sorted([(i, t.replace("a@b.cd", "[EMAIL]") if t else t) for i, t in rows], key=str)
    elif name == "simhash_near_dedup":
        assert sorted(i or 0 for i, _ in texts) == [0, 1, 3, 4]
    else:
        assert set(texts) <= set(rows)
    assert stage(spark, docs.limit(0), DIR).count() == 0


def test_a_task_holds_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "write to ann@example.org"), (2, None), (2, "key=ab12cd34")], "doc_id long, text string")
    for stage in (corpus_pipeline.personal_data, corpus_pipeline.sentencepiece):
        plan = stage(spark, docs, DIR)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1
