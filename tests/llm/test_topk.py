import math
import random

from pyspark.sql import functions as F

from tideloom.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(ok):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(ok) if b != a and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))


def test_as_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(350, rows[7][1]), (350, rows[7][1]), (None, rows[0][1]), (351, None), (352, [None] * 8), (353, [math.nan] * 8), (354, [math.inf] * 8)]
    rng.shuffle(rows)
    own = topk.quantized(frame(spark, rows))
    for nodes, size in ((2, 2048), (4, 37), (1, 37)):
        got = topk.top_k(own, own.filter("vec_id % 50 = 0"), 5, nodes=nodes, rows=size, block=3).collect()
        assert sorted(map(tuple, got)) == brute(rows, 5, 50)


def test_few_rows_huge_values_and_other_dimensions(spark):
    rows = [(0, [1e5, -2e5, 3e5]), (50, [1e7, 1e6, -1e7]), (3, [5e6, 1.0, 2.0]), (100, [1.0, 2.0]), (4, [3.0, 4.0]), (150, [])]
    got = topk.search(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 50)
    assert topk.search(frame(spark, [])).count() == 0
    assert topk.search(frame(spark, [(50, [1.0])])).count() == 0
