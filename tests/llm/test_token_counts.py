import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideloom.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = token_counts.Offsets(PATH)


def brute(text, starts, rule):
    """Every token compared with every part."""
    ends = [*starts[1:], len(text)]
    own, crossing = [0] * len(starts), [0] * len(starts)
    for s, e in LIBRARY.encode(text, add_special_tokens=False).offsets:
        shares = [max(0, min(e, b) - max(s, a)) for a, b in zip(starts, ends, strict=True)]
        touched = [i for i, x in enumerate(shares) if x]
        i = {"start": touched[0], "end": touched[-1], "most": max(touched, key=lambda t: (shares[t], -t))}[rule]
        own[i] += 1
        crossing[i] += len(touched) > 1
    return own, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_as_brute_force(rule):
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choice(["the ", "and", "é", "日本", "🙂", "\n", "\n\n", "  ", "word", ".", "1234"]) for _ in range(rng.randint(1, 40)))
        starts = sorted({0, *(rng.randrange(len(text)) for _ in range(4))})
        n, crossing = token_counts.attribute(token_counts.offsets(text, OWN), starts, len(text), rule)
        assert (n.tolist(), crossing.tolist()) == brute(text, starts, rule)


def test_offsets_as_the_library(monkeypatch):
    LIBRARY.encode_special_tokens = True
    rng = random.Random(13)
    parts = ["The", " quick,", " brown\n", "é", "日本", "🙂🙂", "  ", "\t", "'ll", "x" * 80, "\u00a0", "\u2003", "12", "٣", "_", "\x1c", "\u0558", "\u208f", "<|endoftext|>", "ñandú", "\x85", "\u200b"]
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert list(map(tuple, token_counts.offsets(text, OWN).tolist())) == LIBRARY.encode(text, add_special_tokens=False).offsets, repr(text)
    other = token_counts.Offsets(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.remembers and len(token_counts.offsets("Some words", other)) == 2


def test_documents(spark, docs_of):
    rows = [(1, "one line\n\nthird line <|endoftext|>"), (2, None), (3, ""), (None, "x"), (4, "y\n" * 30000), (1, "one line\n\nthird line <|endoftext|>")]
    docs = docs_of(rows).withColumn("_parts", F.lit(1)).withColumn("part", F.lit("x"))
    got = token_counts.lines_of_documents(docs, PATH).collect()
    for i in (2, 3):
        assert [(r.section, r.n_tokens) for r in got if r.doc_id == i] == [(None, 0)]
    first = sorted((r.section, r.start, r.end) for r in got if r.doc_id == 1)
    assert first == sorted([(0, 0, 9), (1, 9, 10), (2, 10, 34)] * 2)
    for i in (1, 4, None):
        own = [r for r in got if r.doc_id == i]
        assert sum(r.section_tokens for r in own) == own[0].n_tokens * (2 if i == 1 else 1)
    assert token_counts.lines_of_documents(docs_of([]), PATH).count() == 0
    with pytest.raises(ValueError, match="none of"):
        token_counts.section_counts(docs, PATH, rule="half")


def test_fields(spark):
    df = spark.createDataFrame([("role", "some text", None), (None, None, None)], "a string, b string, c string")
    one, none = token_counts.field_counts(df, PATH, ["a", "b", "c"]).collect()
    assert [(p.start, p.end) for p in one._parts] == [(0, 5), (5, 15), (15, 15)]
    assert sum(p.n_tokens for p in one._parts) == one._tokens == len(LIBRARY.encode("role\nsome text\n").ids)
    assert sum(p.n_tokens for p in none._parts) == none._tokens
