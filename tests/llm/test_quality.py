import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tideloom.llm import quality


def corpus(rng, n):
    """Plain prose is good; shouted, symbol-ridden and repeated text is not."""
    words = [("".join(rng.choice("aeioutnsrl") for _ in range(rng.randint(2, 9)))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 200)))
        bad = i % 4 == 0
        if bad:
            text = [text.upper() + "!!", text.replace(" ", "### "), (rng.choice(words) + " ") * 90][i // 4 % 3]
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_held_out_accuracy_and_order_independence(spark, docs_of):
    rows, labels = corpus(random.Random(1), 400)
    docs, labels = docs_of(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.predictions(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 4 != 0) for r in held]) > 0.95
    # labels of held-out rows, lang, source and doc_id are no inputs
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.predictions(docs.repartition(7).withColumn("lang", F.lit("zz")), flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 0.02 for r in got)


def test_edges(spark, docs_of):
    rows, labels = corpus(random.Random(2), 120)
    rows += [(1000, None), (1001, ""), (None, "no id here"), (1, rows[1][1]), (1002, "long words " * 60000)]
    labels += [(1, 1, None), (1000, None, 1), (None, 1, 0), (2, 7, 0)]
    docs = docs_of(rows).withColumn("score", F.lit("clash")).withColumn("y", F.lit(2))
    got = quality.predictions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.predictions(docs, none).collect()} == {quality.UNKNOWN}
    assert quality.predictions(docs_of([]), none).count() == 0


def test_statistics_take_the_whole_text():
    assert not quality.statistics("").any()
    a, b = quality.statistics("ab cd " * 5000), quality.statistics("ab cd " * 5000 + "!" * 3000)
    assert abs(a - b).max() > 0.1
