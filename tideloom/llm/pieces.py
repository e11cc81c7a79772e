"""SentencePiece BPE encoding and decoding by a table of last tokens.

Every prefix of a BPE-encoded text has exactly one last token: the one whose own prefix ends in a
token that it can stand beside. So one pass over the matches of an automaton of all pieces fills a
table "last token of each prefix", and walking it backwards from the end gives the ids. Two tokens can
stand beside each other when merging their joined characters gives back those two tokens.

Texts are cut at white space first, where no piece crosses it, and what a chunk encodes to is
remembered; the table keeps even a chunk without any white space linear in its length.
"""

from __future__ import annotations

import codecs
import re
import string
from array import array
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, once_per_worker, slices, texts

SPACE = "▁"
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"  # where most words end; others only make longer chunks
START, BYTES = -1, -2  # marks in the table: before the text; a character that has no piece
CHUNKS = 400_000  # remembered chunks of a worker; more only cost time
LONGEST = 64  # characters of a chunk that is remembered
ESCAPE = 0xDC00  # bytes from 0x80 travel as the surrogates that stand for them


def _each_byte(error: UnicodeError):
    """One U+FFFD for each byte that is no UTF-8."""
    return "�" * (error.end - error.start), error.end


class Remembered(dict):
    """What ``make`` gives for each chunk, kept unless the chunk is long."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


class Codec:
    """Encoder and decoder of one BPE model file with identity normalization."""

    def __init__(self, model: str):
        codecs.register_error("tideloom-each-byte", _each_byte)
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        count = sp.get_piece_size()
        self.unknown = sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(count)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(count)]
        as_byte = [int(p[3:5], 16) if sp.is_byte(i) else -1 for i, p in enumerate(names)]
        self.byte_id = {b: i for i, b in enumerate(as_byte) if b >= 0}
        self.id_of = {p: i for i, p in enumerate(names) if not special[i] and as_byte[i] < 0}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.names = names
        self.size = [len(p) for p in names]
        self.matches = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.matches.add_word(p, (i, len(p)))
        self.matches.make_automaton()
        self.fits: list[dict[int, bool]] = [{} for _ in names]
        self.built: dict[int, tuple | None] = {}
        self.alphabet = {p for p in self.id_of if len(p) == 1}
        self.chunks = Remembered(self.chunk_ids)
        # a chunk starts at a space, or at a line end where no piece holds one
        line_ends = "" if any("\n" in p for p in self.id_of) else "\n"
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id_of):
            raise ValueError("a piece goes across a space")
        # and it ends before a sign that follows a letter in no piece
        follows = {y for p in self.id_of for x, y in zip(p, p[1:]) if re.match(LETTER, x)}
        signs = re.escape("".join(set(string.punctuation) - follows))
        word = f"{SPACE}*{LETTER}++(?=[{signs}])|" if signs else ""
        self.cut = re.compile(f"{word}{SPACE}+[^{SPACE}{line_ends}]*|[^{SPACE}{line_ends}]+" + (f"|{line_ends}+" * bool(line_ends)))
        shown = [p.replace(SPACE, " ") for p in names]
        for i in range(count):
            if as_byte[i] >= 0:
                shown[i] = chr(as_byte[i] if as_byte[i] < 0x80 else ESCAPE + as_byte[i])
            elif special[i]:
                shown[i] = " ⁇ " if i == self.unknown else ""
        self.shown = shown
        self.silent = {i for i in range(count) if not shown[i]}
        self.odd = {i for i in range(count) if as_byte[i] >= 0x80}

    def merging(self, piece: int) -> tuple | None:
        """How merging builds a piece from its characters, best score first, leftmost on ties.

        The score of each step, then the symbols at its left and at its right edge before each
        step and at the end. None for a piece that merging doesn't build.
        """
        if piece not in self.built:
            parts = list(self.names[piece])
            scores, left, right = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                joined = [self.score.get(x + y, -np.inf) for x, y in zip(parts, parts[1:])]
                best = max(joined)
                if best == -np.inf:
                    break
                i = joined.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                scores.append(best)
                left.append(parts[0])
                right.append(parts[-1])
            self.built[piece] = (scores, left, right) if len(parts) == 1 else None
        return self.built[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces can stand side by side in an encoded text.

        Runs both buildings in the order in which merging would take their steps. They are incompatible
        as soon as the symbols that meet at the border merge better than the next step of either.
        """
        known = self.fits[left].get(right)
        if known is None:
            a, b = self.merging(left), self.merging(right)
            known = self.fits[left][right] = bool(a and b) and not self._crossed(a, b)
        return known

    def _crossed(self, a: tuple, b: tuple) -> bool:
        (ours, _, edge), (theirs, start, _), score = a, b, self.score
        i = j = 0
        while True:
            cross = score.get(edge[i] + start[j])
            own = ours[i] if i < len(ours) else -np.inf
            other = theirs[j] if j < len(theirs) else -np.inf
            if cross is not None and cross > own and cross >= other:
                return True
            if own == other == -np.inf:
                return False
            if own >= other:
                i += 1
            else:
                j += 1

    def table(self, chunk: str) -> list[int | None]:
        """The last token of every prefix of a chunk, with the characters without a piece marked."""
        last: list[int | None] = [None] * (len(chunk) + 1)
        last[0] = START
        if not self.alphabet.issuperset(chunk):
            for i, c in enumerate(chunk):
                if c not in self.id_of:
                    last[i + 1] = BYTES
        fits, compatible = self.fits, self.compatible
        for end, (piece, length) in self.matches.iter(chunk):
            end += 1
            if last[end] is None:
                before = last[end - length]
                if before is None:
                    continue
                if before < 0:
                    last[end] = piece
                else:
                    fit = fits[before].get(piece)
                    if fit or (fit is None and compatible(before, piece)):
                        last[end] = piece
        return last

    def chunk_ids(self, chunk: str) -> bytes:
        """The ids of a chunk, read from the end of its table, as the bytes of 32-bit integers."""
        last, at, ids, size = self.table(chunk), len(chunk), [], self.size
        while at:
            piece = last[at]
            if piece == BYTES:
                raw = chunk[at - 1].encode("utf-8", "surrogatepass")
                ids.extend([self.byte_id[b] for b in reversed(raw)] if self.byte_id else [self.unknown])
                at -= 1
            else:
                ids.append(piece)
                at -= size[piece]
        ids.reverse()
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; the empty text has none."""
        if not text:
            return np.zeros(0, np.int32)
        found = self.chunks
        if len(found) > CHUNKS:
            found.clear()
        chunks = self.cut.findall(SPACE + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(found.__getitem__, chunks)), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: bytes joined to characters, the space put before the text taken off."""
        shown = self.shown
        text = "".join(map(shown.__getitem__, ids))
        if not self.odd.isdisjoint(ids) and not self.silent.isdisjoint(ids):
            # bytes on either side of a token that shows nothing don't make one character
            runs = [list(g) for quiet, g in groupby(ids, self.silent.__contains__) if not quiet]
            text = "".join("".join(map(shown.__getitem__, r)).encode("utf-8", "surrogateescape").decode("utf-8", "tideloom-each-byte") for r in runs)
        first = next((i for i in ids if shown[i]), None)
        if first is not None and self.names[first][0] == SPACE:
            text = text[1:]
        if not text.isascii() and not self.odd.isdisjoint(ids):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "tideloom-each-byte")
        return text


def codec(model: str) -> Codec:
    return once_per_worker(f"pieces {model}", lambda: Codec(model))


def encode(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as array<int> in ``out``.

    A null or empty text gives an empty array. Other columns pass unchanged; one named like
    ``out`` is replaced. No shuffle: rows stay where they are.
    """
    docs = docs.drop(out)

    def run(batches):
        own = codec(model)
        for b in slices(batches, 500):
            ids = list_array([own.encode(t) for t in texts(b.column(text))], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, out])

    return docs.mapInArrow(run, docs.withColumn(out, F.lit(None).cast("array<int>")).schema)


def decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in ``out``. Null ids give the empty text."""
    encoded = encoded.drop(out)

    def run(batches):
        own = codec(model)
        for b in slices(batches, 500):
            col = b.column(ids)
            flat, ends = col.flatten().to_pylist(), np.cumsum([0, *(n or 0 for n in map(_length, col))])
            shown = [own.decode(flat[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shown, pa.string())], [*b.schema.names, out])

    return encoded.mapInArrow(run, encoded.withColumn(out, F.lit(None).cast("string")).schema)


def _length(x: pa.Scalar) -> int:
    return len(x) if x.is_valid else 0


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    both = decode(encode(docs.select("doc_id", "text"), model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
