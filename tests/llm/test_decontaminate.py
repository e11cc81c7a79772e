import random

from pyspark.sql import functions as F

from tideloom.llm import decontaminate as dc


def brute(doc, item, least):
    """Greedy tiling from its definition: the longest free common run, again and again."""
    used_d, used_i, found = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in used_i and d + n not in used_d:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return found
        found.append((i, d, n))
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))


def test_tiles_as_defined():
    rng = random.Random(14)
    for k in range(200):
        words = [f"w{i}" for i in range(rng.choice([3, 8, 30]))]
        item = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        doc = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        cut = rng.randint(0, len(item))
        doc += item[cut:] + doc[:3] + item[:cut]
        got, want = dc.tiles(doc, item, 3), brute(doc, item, 3)
        assert sorted(n for *_, n in got) == sorted(n for *_, n in want), k
        for i, d, n in got:
            assert item[i : i + n] == doc[d : d + n]
        for side in (0, 1):
            marked = [t[side] + j for t in got for j in range(t[2])]
            assert len(marked) == len(set(marked))


def make(rng, n):
    return [f"t{rng.randrange(500)}" for _ in range(n)]


def test_leaks(spark, docs_of):
    rng = random.Random(15)
    items = [make(rng, 40) for _ in range(10)]
    text = lambda *parts: " ".join(w for p in parts for w in p)
    rows = [
        (1, text(make(rng, 60), items[0], make(rng, 50))),
        (2, text(make(rng, 9), items[1][20:], make(rng, 30), items[1][:20])),  # reordered
        (3, ",\n".join(w.upper() for w in make(rng, 9) + items[2])),  # other case and punctuation
        (4, text(make(rng, 40), items[3][:20])),  # half of it
        (5, text(make(rng, 300))),
        (6, text(items[4][:18], ["x"], items[4][19:])),  # a word changed
        (7, None), (8, ""), (None, text(items[5])), (9, text(items[6] * 300)), (9, text(items[6] * 300)),
    ]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (52, "t1 t2"), (0, " ".join(items[0]))]
    bench = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = docs_of(rows).withColumn("row", F.lit(1)).withColumn("_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.coverage for r in dc.report(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2), (6, 4), (None, 5), (9, 6)}
    assert got[(2, 1)] == 1 and 0.9 < got[(6, 4)] < 1
    kept = dc.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 7, 8]
    assert dc.report(docs_of([]), bench).count() == 0
    assert dc.report(docs, bench.limit(0)).count() == 0
