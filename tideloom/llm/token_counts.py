"""Token counts of the parts of a document, from one encoding of the whole.

A document is encoded once with the offsets of its tokens. The tokens' character spans are joined with the spans
of the parts. Spans of tokens rise, and those of parts don't overlap, so the interval join is a merge of two
sorted lists. A token across a border belongs to the part that holds its first character; characters that share
several tokens (the bytes of one character) count every token where the character lies.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from itertools import cycle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import once_per_worker, slices, texts

RULES = ("start", "end", "most")  # the part of a token's first or last character, or of most of its characters
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
PRE_TOKEN = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # fixed: how byte-level texts are cut
REMEMBERED, LONGEST = 400_000, 64  # pre-tokens of a worker, and the characters of one at most
COUNTS = ("part", "start", "end", "n_tokens", "n_crossing")
COUNTS_SQL = "array<struct<part:int,start:int,end:int,n_tokens:bigint,n_crossing:bigint>>"


def _shown_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable Latin-1."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Offsets(dict):
    """Token offsets of a byte-level tokenizer by its pre-tokens, whose tokens are remembered.

    A pre-token is encoded by itself whatever stands around it. Texts with a character that the pattern here
    and the library's take for different kinds go through the library whole, as do all with other tokenizers.
    """

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        own, pre = self.library, repr(self.library.pre_tokenizer)
        simple = pre.startswith("ByteLevel(add_prefix_space=False,") and pre.endswith("use_regex=True)")
        self.remembers = simple and own.normalizer is None and own.post_processor is None
        self.shown = _shown_bytes()
        self.alike: dict[str, bool] = {}
        self.sizes = [len(own.id_to_token(i) or "") for i in range(own.get_vocab_size())] if self.remembers else []

    def same_kind(self, c: str) -> bool:
        known = self.alike.get(c)
        if known is None:
            probe = f"a{c}b1{c}.{c}{c} {c}"
            theirs = [o for _, o in self.library.pre_tokenizer.pre_tokenize_str(probe)]
            known = self.alike[c] = theirs == [m.span() for m in PRE_TOKEN.finditer(probe)]
        return known

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        sizes, flat, at = self.sizes, [], 0  # of tokens in bytes
        for token in self.library.model.tokenize("".join(map(self.shown.__getitem__, raw))):
            flat.append(at)
            at += sizes[token.id]
            flat.append(at)
        if len(raw) > len(piece):
            char = [i for i, c in enumerate(piece) for _ in c.encode()]  # of each byte
            flat = [char[x - k] + k for x, k in zip(flat, cycle((0, 1)))]
        spans = array("i", flat).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = spans
        return spans

    def of(self, text: str) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        pieces = PRE_TOKEN.findall(text)
        spans = [self[p] for p in pieces]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(len, spans), np.int64, len(spans)) // 8
        own = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
        return own + np.repeat(np.cumsum(sizes) - sizes, counts)[:, None]


def tokenizer(path: str) -> Offsets:
    return once_per_worker(f"tokenizer {path}", lambda: Offsets(path))


def offsets(text: str, own: Offsets) -> np.ndarray:
    """Character spans of all tokens of a whole text, in order."""
    if own.remembers and (text.isascii() or all(map(own.same_kind, set(text)))):
        return own.of(text)
    return np.array(own.library.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)


def lines(text: str) -> list[int]:
    """Sections: the lines of a text, each with the line end that closes it."""
    return [0, *(m.end() for m in re.finditer("\n", text) if m.end() < len(text))]


def paragraphs(text: str) -> list[int]:
    """Sections that blank lines end."""
    return [0, *(m.end() for m in BLANK_LINE.finditer(text) if m.end() < len(text))]


def attribute(spans: np.ndarray, starts: list[int], length: int, rule: str = "start") -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each part gets, and how many of these lie across a border.

    ``starts`` are the rising first characters of parts that cover the text from 0 to ``length``. With "most" a
    tie goes to the earlier part.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(starts, spans[:, 0], "right") - 1
    last = np.searchsorted(starts, np.maximum(spans[:, 0], spans[:, 1] - 1), "right") - 1
    crossing = first != last
    own = {"start": first, "end": last, "most": first.copy()}[rule]
    if rule == "most":
        ends = [*starts[1:], length]
        for i in np.flatnonzero(crossing):
            s, e = spans[i]
            shares = [min(e, ends[p]) - max(s, starts[p]) for p in range(first[i], last[i] + 1)]
            own[i] = first[i] + int(np.argmax(shares))
    return np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n)


def _counts(docs: list[tuple[str, list[int]]], own: Offsets, rule: str) -> tuple[pa.Array, pa.Array]:
    """The counts of the parts of each (text, starts), and of the whole texts."""
    parts, sizes, totals = [], [0], []
    for text, starts in docs:
        spans = offsets(text, own)
        totals.append(len(spans))
        sizes.append(len(starts))
        if starts:
            begin = np.array(starts)
            parts.append((np.arange(len(starts)), begin, np.append(begin[1:], len(text)), *attribute(spans, starts, len(text), rule)))
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
    kinds = [pa.int32()] * 3 + [pa.int64()] * 2
    flat = pa.StructArray.from_arrays([pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], list(COUNTS))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), flat), pa.array(totals, pa.int64())


def _checked(rule: str) -> str:
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    return rule


def section_counts(docs: DataFrame, path: str, sections: Callable[[str], list[int]] = lines, rule: str = "start") -> DataFrame:
    """``docs`` with the counts of each section of ``text`` in _parts and of the whole text in _tokens.

    A null or empty text has no section and no token. Counts of the sections add up to the whole.
    """
    docs, rule = docs.drop("_parts", "_tokens"), _checked(rule)

    def run(batches):
        own = tokenizer(path)
        for b in slices(batches, 200):
            parts, totals = _counts([(t, sections(t) if t else []) for t in texts(b.column("text"))], own, rule)
            yield pa.RecordBatch.from_arrays([*b.columns, parts, totals], [*b.schema.names, "_parts", "_tokens"])

    return docs.mapInArrow(run, docs.withColumns({"_parts": F.lit(None).cast(COUNTS_SQL), "_tokens": F.lit(None).cast("bigint")}).schema)


def field_counts(rows: DataFrame, path: str, fields: list[str], joint: str = "\n", rule: str = "start") -> DataFrame:
    """``rows`` with the counts of text columns in _parts and of their joined text in _tokens.

    The columns are encoded as one text with ``joint`` between them. A joint belongs to the field before it.
    Null fields are empty. Parts are numbered as the fields are listed; one of no characters gets no token.
    """
    rows, rule = rows.drop("_parts", "_tokens"), _checked(rule)
    shape = rows.withColumns({"_parts": F.lit(None).cast(COUNTS_SQL), "_tokens": F.lit(None).cast("bigint")}).schema

    def run(batches):
        own = tokenizer(path)
        for b in slices(batches, 200):
            joined = []
            for values in zip(*[texts(b.column(f)) for f in fields], strict=True):
                sizes = [len(v) + len(joint) for v in values]
                joined.append((joint.join(values), np.cumsum([0, *sizes[:-1]]).tolist()))
            parts, totals = _counts(joined, own, rule)
            yield pa.RecordBatch.from_arrays([*b.columns, parts, totals], [*b.schema.names, "_parts", "_tokens"])

    return rows.mapInArrow(run, shape)


def lines_of_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens (of the whole text), and section, start, end, section_tokens and crossing_tokens of each line.

    A text without lines gives one row whose section is null. Repeated rows give repeated results.
    """
    counted = section_counts(docs.select("doc_id", "text"), path).select("doc_id", "_tokens", F.explode_outer("_parts").alias("p"))
    return counted.select(
        "doc_id", F.col("_tokens").alias("n_tokens"), F.col("p.part").alias("section"), "p.start", "p.end",
        F.col("p.n_tokens").alias("section_tokens"), F.col("p.n_crossing").alias("crossing_tokens"),
    )
