import hashlib
import random
import re
from collections import Counter

from tideloom.llm import substrings


def brute(texts, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, docs_of, texts, **options):
    got = substrings.digests(docs_of(list(enumerate(texts))), **options).collect()
    assert [tuple(r)[1:] for r in sorted(got, key=lambda r: r.doc_id)] == brute(texts, options["width"])


def corpus(rng):
    words = [f"w{i}é" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(0, 90))] for _ in range(40)]
    texts = [" ".join(x) for x in base]
    for _ in range(40):  # passages, cut anywhere, between other words
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randint(0, 60), rng.randint(0, 60)
        texts.append("\n\t".join(a[i : i + rng.randint(3, 40)] + [rng.choice(words)] * rng.randint(0, 3) + b[j : j + 30]))
    texts += [texts[3], texts[3] + "  ", "same " * 200, "ab cd " * 40, None, "", " \n", texts[5] * 2]
    return texts


def test_as_brute_force(spark, docs_of):
    texts = corpus(random.Random(9))
    check(spark, docs_of, texts, width=10, gram=4)
    check(spark, docs_of, texts, width=10, gram=4, hot=2)  # common anchors over several shards


def test_edges(spark, docs_of):
    long = " ".join(f"t{i}" for i in range(30000))
    check(spark, docs_of, [long, "x " + long[-500:], "short"], width=35, gram=12)
    check(spark, docs_of, [], width=35, gram=12)
    rows = [(None, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g")]
    assert {tuple(r)[1:3] for r in substrings.digests(docs_of(rows), 5, 2).collect()} == {(7, 7)}
