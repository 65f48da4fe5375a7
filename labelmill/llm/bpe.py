"""Byte-level BPE by a sentencepiece model that is written from a vocabulary of ranks.

Nothing is trained: a file of byte strings and their ranks holds all merges.  It
becomes a sentencepiece model of the BPE kind in which

* a piece is a byte string whose bytes are written as one character each,
* its score is its negative rank, so the pair that merges next is that of the
  least rank, the leftmost one of equal pairs,
* normalisation is the identity, with no prefix and no escaped spaces.

A text is cut into pre-tokens by a pattern, a pre-token that is a piece is that
piece, and any other is merged by sentencepiece.  Decoding looks the pieces of
the ids up in the model and maps their characters back to bytes, so what comes
back is, byte for byte, the text.

The model (about 1 MB, a property of the vocabulary) travels with the functions.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import slices, whole_text

#: Rows and pre-tokens that are looked up together, and pre-tokens that a task remembers; only short ones are kept.
ROWS = 512
AT_ONCE = 100_000
KNOWN = 120_000
KNOWN_CHARS = 40

#: Texts of more characters than this are cut into pre-tokens a stretch at a time.
LONG_TEXT = 2_000_000

# Fixed values of the model format: field numbers, kinds of pieces, kind of model.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN = 1, 2
_BPE = 2

# Stands for what no piece covers; with all 256 bytes as pieces, that is nothing.
UNKNOWN = "<unk>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file by rank; ranks are gapless from 0 and hold every single byte."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    tokens = [ranks[k] for k in range(len(ranks))]
    missing = 256 - sum(len(t) == 1 for t in tokens)
    if missing or len(set(tokens)) < len(tokens):
        raise ValueError(f"{path}: {missing} single bytes are missing, or a token repeats")
    return tokens


def byte_characters() -> list[str]:
    """One visible character for each byte: itself if it is printable Latin-1, else one of the next code points from 256."""
    out, at = [], 256
    for b in range(256):
        visible = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if visible else at))
        at += not visible
    return out


_TO = dict(enumerate(byte_characters()))
_FROM = {ord(c): b for b, c in _TO.items()}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO)


def unmapped(piece: str) -> bytes:
    return piece.translate(_FROM).encode("latin-1")


def _varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _float(field: int, x: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", x)


def serialized(tokens: list[bytes]) -> bytes:
    """The sentencepiece model of a vocabulary; the id of a piece is its rank."""
    pieces = [_bytes(1, mapped(t).encode()) + _float(2, -float(rank)) + _number(3, _NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(_bytes(1, UNKNOWN.encode()) + _float(2, -float(len(tokens))) + _number(3, _UNKNOWN))
    # Model kind and size; ids of the unknown piece and of the absent start, end and padding pieces.
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, len(tokens)) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    # No dummy prefix, extra spaces stay, spaces are not escaped.
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(_bytes(_PIECE, p) for p in pieces) + _bytes(_TRAINER, trainer) + _bytes(_NORMALIZER, normalizer)


class Codec:
    """Texts to ids and back by a serialised model; ids are little-endian unsigned 32-bit integers in a row."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pre_tokens = regex.compile(pattern)
        n = self.model.get_piece_size() - 1
        pieces = [self.model.id_to_piece(k) for k in range(n)]
        self.raw = [unmapped(p) for p in pieces]
        self.whole = {p: struct.pack("<I", k) for k, p in enumerate(pieces)}
        self.known: dict[str, bytes] = {}

    def _ids(self, pre_tokens: list[str]) -> list[bytes]:
        """Ids of every pre-token, found once for all equal ones."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        new = {w: mapped(w.encode("utf-8", "surrogatepass")) for w in set(pre_tokens) if w not in known}
        found = {w: self.whole[m] for w, m in new.items() if m in self.whole}
        merge = [(w, m) for w, m in new.items() if w not in found]
        for (w, _), ids in zip(merge, self.model.encode([m for _, m in merge], out_type=int, num_threads=1)):
            found[w] = np.array(ids, dtype="<u4").tobytes()
        known.update(found)
        out = [known[w] for w in pre_tokens]
        for w in found:
            if len(w) > KNOWN_CHARS:
                del known[w]
        return out

    def _stretches(self, text: str) -> Iterator[list[str]]:
        matches = self.pre_tokens.finditer(text)
        while some := [m.group() for m in islice(matches, AT_ONCE)]:
            yield some

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text; short texts are looked up many at once."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            words = self.pre_tokens.findall(text) if len(text) <= LONG_TEXT else None
            if words is not None:
                waiting.append(words)
                size += len(words)
            if size > AT_ONCE or words is None:
                yield from self._joined(waiting)
                waiting, size = [], 0
            if words is None:
                yield b"".join([ids for some in self._stretches(text) for ids in self._ids(some)])
        yield from self._joined(waiting)

    def _joined(self, texts: list[list[str]]) -> Iterator[bytes]:
        ids = self._ids([w for words in texts for w in words]) if texts else []
        at = 0
        for words in texts:
            yield b"".join(ids[at:at + len(words)])
            at += len(words)

    def decode(self, ids: bytes) -> bytes:
        raw = self.raw
        return b"".join([raw[k] for k in np.frombuffer(ids, dtype="<u4").tolist()])


def codec(vocabulary: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The model and the pattern that :func:`encode` and :func:`decode` take; the file is read once, by the driver."""
    return serialized(read_ranks(vocabulary or default_vocabulary())), pattern or default_pattern()


def encode(text: Column, by: tuple[bytes, str]) -> Column:
    """Ids of a text as a binary of little-endian unsigned 32-bit integers; null for null."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Codec(*by)
        for texts in slices(batches, ROWS):
            found = words.encode(t for t in texts.to_pylist() if t is not None)
            yield pa.array([next(found) if valid else None for valid in texts.is_valid().to_pylist()], pa.binary())

    return ids(text)


def decode(ids: Column, by: tuple[bytes, str]) -> Column:
    """The bytes that ids stand for; null for null."""

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = Codec(*by)
        for rows in slices(batches, ROWS):
            yield pa.array([None if r is None else words.decode(r) for r in rows.to_pylist()], pa.binary())

    return raw(ids)


def encoded(docs: DataFrame, by: tuple[bytes, str] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``, in place of columns of these names.

    A null or empty text has no ids.  Texts are encoded whole and row by row:
    repeated rows each, an empty table stays empty, and no row is moved.
    """
    return docs.withColumn("ids", encode(whole_text(), by or codec())).withColumn("n_tokens", (F.length("ids") / 4).cast("long"))


def decoded(rows: DataFrame, by: tuple[bytes, str] | None = None) -> DataFrame:
    """Rows of :func:`encoded` with ``decoded``, the bytes of their texts; rows without ids have null."""
    return rows.withColumn("decoded", decode(F.col("ids"), by or codec()))
