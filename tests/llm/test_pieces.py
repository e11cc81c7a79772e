import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tideloom.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.Codec(MODEL)


CASES = [
    "", " ", "  two  ", "▁a▁", "\n\n x\t", "é𝔘日本　\x00", "<s></s><0x41>", "a" * 5000, " " * 3000, "Ab.\ncd,### ef!!%%% ²x²",
    "ﬁ Å", "xyz" * 2000 + "🙂🙂", "the the the", "1,234.50 (a) [b]",
]


@pytest.mark.parametrize("text", CASES)
def test_cases_as_the_library(own, text):
    ids = LIBRARY.encode(text)
    assert own.encode(text).tolist() == ids
    assert own.decode(ids) == LIBRARY.decode(ids)


def test_random_texts_and_random_ids(own):
    rng = random.Random(5)
    letters = "aab bcd  \n\t▁é𝔘日本　\x00xyzthe<>s12.,#!ñß"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert own.encode(text).tolist() == LIBRARY.encode(text), text
        ids = [rng.randrange(32000) if rng.random() < 0.4 else rng.randrange(259) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == LIBRARY.decode(ids), ids


def test_frames(spark, docs_of):
    rows = [(1, "Some text.\nMore"), (2, None), (3, ""), (None, "no id"), (1, "Some text.\nMore"), (5, "x " * 20000)]
    docs = docs_of(rows).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.ids) == LIBRARY.encode(r.text or "")
        assert r.decoded == LIBRARY.decode(list(r.ids))
        assert r.lang == "en"
    assert pieces.digests(docs_of([]), MODEL).count() == 0
    null = {r.doc_id: r for r in pieces.digests(docs, MODEL).collect()}[2]
    assert (null.n_tokens, null.ids_sha256) == (0, null.decoded_sha256)
