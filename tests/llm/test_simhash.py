import random

import xxhash
from pyspark.sql import functions as F

from tideloom.llm import simhash
from tideloom.llm.components import components


def brute(prints, radius):
    """Smallest index reachable, by comparing all pairs."""
    up = list(range(len(prints)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) % 2**64).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(prints))]


def naive(text, words=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    w = [x.decode() for x in w]
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint_as_defined():
    for text in ("", "a", "a b c", "Ä B c D e", "x y " * 300, "the cat sat on the mat and the cat sat"):
        assert simhash.fingerprint(text, 4, 42) % 2**64 == naive(text)


def flip(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def sample_prints(rng, n):
    prints = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        prints.append(flip(rng, rng.choice(prints), rng.randint(0, 7)))
    return [p - 2**64 if p >> 63 else p for p in dict.fromkeys(prints)]


def test_every_link_counts(spark):
    rng = random.Random(3)
    prints = sample_prints(rng, 60)
    want = brute(prints, 4)
    df = spark.createDataFrame([(p,) for p in prints], "_print long")
    for part in (simhash.PART, 3):  # the small part splits the shards into several trees
        got = {r.node: r.root for r in components(simhash.links(df, 4, part=part)).collect()}
        groups = {}
        for p, w in zip(prints, want, strict=True):
            groups.setdefault(w, []).append(p)
        for members in groups.values():
            assert {got.get(p, p) for p in members} == {min(members)}
        assert len({got.get(p, p) for p in prints}) == len(groups)


def test_one_dense_shard_is_whole():
    rng = random.Random(4)
    base = rng.getrandbits(63)
    prints = list({flip(rng, base, rng.randint(0, 3)) for _ in range(200)} | {flip(rng, base, 9) for _ in range(50)})
    prints = [p - 2**64 if p >> 63 else p for p in prints]
    want, found = brute(prints, 4), dict(simhash.tree_edges(prints, 4))
    label = {}
    for p, w in zip(prints, want, strict=True):
        assert label.setdefault(w, found.get(p, p)) == found.get(p, p)
    assert len(set(label.values())) == len(label)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(9, long), (3, long.upper()), (5, long + " end"), (4, None), (8, ""), (6, " \t\n"), (None, long), (9, long), (7, "other words here now")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs_of(rows)).collect()}
    print_of = {i: f for i, f, _ in got}
    assert print_of[9] == print_of[3] and print_of[4] == "0" * 16
    by_id = {i: c for i, _, c in got}
    assert by_id[9] == by_id[3] == by_id[5] == by_id[None] == 3
    assert by_id[4] == by_id[8] == by_id[6] == 4 and by_id[7] == 7
    assert simhash.near_duplicates(docs_of(rows)).count() == len(rows)
    assert simhash.near_duplicates(docs_of([])).count() == 0
    clash = docs_of(rows).withColumn("_print", F.lit("x")).withColumn("fingerprint", F.lit(1))
    assert simhash.near_duplicates(clash).count() == len(rows)


def test_one_document_of_each_component_stays(spark, docs_of):
    rng = random.Random(21)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(120, 900))]
        for k in range(1 if g % 3 else 6):
            copy = list(base)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy) if k != 5 else "  ".join(copy).upper()))
    rows += [(500, None), (501, ""), (502, "  "), (None, rows[0][1]), (0, rows[0][1]), (503, "x " * 60000), (None, "nobody has these words"), (None, "nobody has these words")]
    docs = docs_of(rows).withColumn("_id", F.lit(1)).withColumn("_row", F.lit("clash")).withColumn("first", F.lit(2))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute([naive(t or "") for _, t in rows], 4)
    firsts = {}
    for (i, _), g in zip(rows, want, strict=True):
        firsts.setdefault(g, set()).add(i)
    want = sorted(min((i is None, i) for i in ids) for ids in firsts.values())
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == want
    assert simhash.keep_one(docs_of([])).count() == 0
