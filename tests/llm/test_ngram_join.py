import random

import pytest
from pyspark.sql import functions as F

from tideloom.llm import ngram_join as nj


def plain_set(text, words=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, percent=80):
    """(doc_id, n, smallest doc_id reachable) by comparing all pairs."""
    sets, up = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(docs, **kw):
    return sorted(map(tuple, nj.report(docs, **kw).collect()), key=str)


def copies(rng):
    words = [f"word{i}" for i in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 40, 150]))] + rng.choice([[], passage])
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 5)}"
            rows.append(" ".join(copy[: rng.choice([len(copy), len(copy), max(1, len(copy) * 9 // 10)])]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_classes_as_brute_force_finds_them(spark, docs_of, monkeypatch, small):
    if small:  # chunks, lists and hot shingles of very few sets
        for name, value in (("CHUNK", 500), ("HOT", 2), ("PART", 3), ("ROUNDS", 2)):
            monkeypatch.setattr(nj, name, value)
    texts = copies(random.Random(7))
    rows = list(enumerate(texts)) + [(None, texts[3]), (3, texts[3]), (900, texts[5].upper() + " \n"), (901, None), (902, ""), (903, " \t"), (None, None), (904, "ÄB äb Äb"), (905, "äb äb äb"), (None, "nobody else")]
    docs = docs_of(rows).withColumn("set_id", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("raw", F.lit(1))
    assert found(docs) == brute(rows)
    assert nj.report(docs_of([])).count() == 0


def test_a_star_of_copies_is_one_class(spark, docs_of, monkeypatch):
    # each copy has 0.82 with the base and about 0.67 with the others; the lists are long and have one class only by the base
    monkeypatch.setattr(nj, "PART", 64)
    rng = random.Random(31)
    base = [f"w{i}" for i in range(304)]
    rows = []
    for k in range(200):
        copy = list(base)
        for at in rng.sample(range(5, 295, 6), 6) if k != 100 else ():
            copy[at] = f"c{k}x{at}"
        rows.append((k, " ".join(copy)))
    assert found(docs_of(rows)) == brute(rows)


def test_the_border_of_similarity(spark, docs_of):
    # 4 of 5, 8 of 10 and 80 of 100 shingles are linked; 79 of 100 aren't
    rows = []
    for few, many in ((4, 5), (8, 10), (80, 100), (79, 100), (12, 15), (11, 15)):
        w = [f"v{few}x{many}x{i}" for i in range(many + 4)]
        rows += [(len(rows), " ".join(w[: few + 4])), (len(rows) + 1, " ".join(w))]
    assert found(docs_of(rows)) == brute(rows)
    assert [c for *_, c in sorted(found(docs_of(rows)))] == [0, 0, 2, 2, 4, 4, 6, 7, 8, 8, 10, 11]


def test_a_very_long_text(spark, docs_of):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(60000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:55000])), (3, " ".join(long[:40000])), (4, "x " * 50000)]
    assert [c for *_, c in sorted(found(docs_of(rows)))] == [1, 1, 3, 4]


def test_only_texts_that_share_a_shingle_are_looked_up(spark):
    docs = spark.createDataFrame([(i, f"alone {i} " * 8) for i in range(300)] + [(900, "a b c d e f g h"), (901, "a b c d e f g h i"), (None, None)], "doc_id long, text string")
    chosen = docs.filter("doc_id >= 900").select(F.xxhash64("text").alias("raw"))
    kept = [r.doc_id for r in nj.perhaps_in(docs, chosen).collect()]
    assert {900, 901} <= set(kept) and len(kept) < 10
    assert not nj.perhaps_in(docs, chosen.limit(0)).take(1)
