"""Removing repeated passages by suffix arrays with a common-prefix interval tree.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a
document with a smaller id.

Finding candidates.  Every window of ``LENGTH`` bytes has an anchor, the place
where the hash of ``GRAM`` bytes is smallest in it, so equal windows have equal
anchors.  About one byte in fifteen is an anchor.  The *context* of an anchor,
``LENGTH - GRAM`` bytes before it to ``LENGTH`` bytes after its start, holds all
windows with that anchor.  Tasks send hashes of anchor and context, one row per
document and context, after dropping contexts that a smaller document of the
same batch has too: those are wholly covered at once.  Contexts with several
documents are decided by the smallest of them.

Deciding the rest.  A window either has the ``REACH`` bytes before its anchor
or those after its gram, so different contexts can share a window only if they
share one of these halves.  Where they do, at the ends of passages and at edits,
one context per smallest document is fetched from its text.  A suffix array over these contexts (sorted by ranks of doubled prefixes)
is enhanced with the lengths of common prefixes, and a scan with a stack gives
the tree of prefix intervals.  An interval whose occurrences differ in the byte
to their left is a maximal repeat; all of its occurrences but those of the
smallest document lose its bytes.  Any pair of equal windows lies in a maximal
repeat, so the union of these bytes is exactly what the rule removes.

Anchors meet by the code of their gram, in cells whose number grows with the
input.  A cell of more than ``CELL_ANCHORS`` anchors hands out its commonest
grams, whose contexts Spark groups with partial minima instead (``_crowded``),
so that no task holds a gram of any number of occurrences.  Anchors with more
than ``HOT_CONTEXTS`` contexts to compare are not gathered either: their windows
are grouped by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import whole_text
from labelmill.operators.scale import cut_lineage

LENGTH = 50
GRAM = 20
BEFORE = LENGTH - GRAM
WINDOWS = BEFORE + 1
CONTEXT = BEFORE + LENGTH
REACH = BEFORE // 2

#: Bytes that are hashed at once, and by how much parts of a longer text overlap.
PART_BYTES = 1 << 18
OVERLAP = 2 * CONTEXT

#: Bytes of text whose anchors meet in one cell, and the most anchors that one holds.
CELL_BYTES = 1 << 25
CELL_ANCHORS = 4_000_000

#: Contexts in one suffix array.
ARRAY_CONTEXTS = 20_000
HOT_CONTEXTS = 200_000

_LARGEST = 2**63 - 1
_U = np.uint64

_SENT = "part int, cell int, id long, key long, spans binary, codes binary, doc binary, pos binary, ids binary, keys binary"
_FOUND = "kind int, id long, key long, spans binary, h long, pos long, left long, right long, upper long, lower long"
_CONTEXTS = "h long, id long, key long, pos long, before int, bytes binary"
_SPANS = "id long, key long, spans binary"


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


class Anchors:
    """Anchors of byte strings, by hashes that are built from halves."""

    def __init__(self):
        self.byte, self.m = _random(256, 1), _random(8, 2)

    @staticmethod
    def slide(x: np.ndarray, width: int, best) -> np.ndarray:
        """Smallest or largest of every ``width`` neighbours."""
        step = 1
        while 2 * step <= width:
            x = best(x[:-step], x[step:])
            step *= 2
        return best(x[: len(x) - (width - step)], x[width - step:]) if width > step else x

    def find(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all anchors, and five codes of each: of its gram, of the
        halves to the left and right (0 if the string ends in it), and two of the
        whole context.  Together they are 160 bits that stand for the context, of
        which 64 depend on all of it.

        ``starts`` are the bounds of the strings in ``data``; windows and
        contexts never cross them.
        """
        none = np.empty(0, np.int64), np.empty((5, 0), np.uint32)
        if len(data) < LENGTH:
            return none
        m = self.m
        pair = lambda h, by, k: h[:-by] * m[k] + h[by:]
        h1 = self.byte[data]
        h2 = pair(h1, 1, 0)
        h4 = pair(h2, 2, 1)
        h16 = pair(pair(h4, 4, 2), 8, 3)
        h = h16[: len(h16) - 4] * m[4] + h4[16:]
        h = (h ^ (h >> _U(29))) * m[5]
        h ^= h >> _U(32)
        least = self.slide(h, WINDOWS, np.minimum)
        for end in starts[1:-1].tolist():
            least[max(0, end - LENGTH + 1):end] = 0
        for k in np.flatnonzero(np.diff(starts) < LENGTH).tolist():
            least[starts[k]:starts[k + 1]] = 0
        pad = np.zeros(WINDOWS - 1, np.uint64)
        x = np.flatnonzero((self.slide(np.concatenate([pad, least, pad]), WINDOWS, np.maximum) == h) & (h != 0))
        if not len(x):
            return none
        of = np.searchsorted(starts, x, side="right") - 1
        lo, hi = starts[of], starts[of + 1]
        whole = (x - BEFORE >= lo) & (x + LENGTH <= hi)
        context = np.zeros(len(x), np.uint64)
        h32 = pair(h16, 16, 6)
        if whole.any():
            h64 = pair(h32, 32, 7)
            at = x[whole] - BEFORE
            context[whole] = h64[at] * m[5] + h16[at + 64]
        raw = data.tobytes() if not whole.all() else b""
        for k in np.flatnonzero(~whole).tolist():
            a, b = max(lo[k], x[k] - BEFORE), min(hi[k], x[k] + LENGTH)
            context[k] = xxhash.xxh64_intdigest(raw[a:b], int(x[k] - a))

        def half(at: np.ndarray, ok: np.ndarray) -> np.ndarray:
            """Code of the GRAM + REACH bytes from ``at``: of 32 of them, and of the last four."""
            out = np.zeros(len(at), np.uint64)
            out[ok] = h32[at[ok]] * m[1] + h4[at[ok] + GRAM + REACH - 4]
            return out

        left = half(x - REACH, x - REACH >= lo)
        right = half(x, x + GRAM + REACH <= hi)
        codes = np.stack([h[x], left, right, context])
        codes = (codes ^ (codes >> _U(31))) * m[1]
        codes ^= codes >> _U(29)
        codes = np.concatenate([codes >> _U(32), codes[3:]]).astype(np.uint32)
        codes[1:3] = np.where(np.stack([left, right]) == 0, 0, np.maximum(codes[1:3], 1))
        return x, codes


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of ``(start, end)`` rows as maximal runs in order."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(spans) - 1)]], axis=1)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values starts."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return new


def _in_order(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Order in which equal grams, in them equal contexts, and in these the documents' ids come together.

    One number of gram and context tells almost all apart; only ties are sorted in full.
    """
    number = codes[0].astype(np.uint64) << _U(32) | codes[4]
    order = np.argsort(number)
    number = number[order]
    same = number[1:] == number[:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] = same
    tied[:-1] |= same
    at = np.flatnonzero(tied)
    rows = order[at]
    order[at] = rows[np.lexsort((own[rows], codes[3, rows], codes[2, rows], codes[1, rows], number[at]))]
    return order


def _covered(docs: np.ndarray, pos: np.ndarray, ids: np.ndarray, keys: np.ndarray, kind=None):
    """Rows of spans per document for contexts that are covered as a whole.

    Spans may reach over the ends of a text; they are cut when they are applied.
    """
    order = np.lexsort((pos, docs))
    docs, pos = docs[order], pos[order]
    starts = np.flatnonzero(_runs(docs))
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(docs)).tolist()):
        p = pos[a:b]
        yield int(ids[docs[a]]), int(keys[docs[a]]), merged(np.stack([p - BEFORE, p + LENGTH], axis=1)).astype("<i8").tobytes()


def _sent(parts: int, cells: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
            found: list[tuple] = []
            part, size = [], 0

            def flush():
                nonlocal part, size
                if part:
                    starts = np.concatenate([[0], np.cumsum([len(p[2]) for p in part])])
                    x, codes = anchors.find(np.frombuffer(b"".join(p[2] for p in part), np.uint8), starts)
                    of = np.searchsorted(starts, x, side="right") - 1
                    doc, base, lo, hi = (np.array([p[k] for p in part])[of] for k in (0, 1, 3, 4))
                    pos = x - starts[of] + base
                    own = (pos >= lo) & (pos < hi)
                    found.append((doc[own], pos[own], codes[:, own]))
                part, size = [], 0

            for d, text in enumerate(batch.column(2).cast(pa.binary())):
                data = text.as_py()
                for at in range(0, max(len(data), 1), PART_BYTES):
                    lo, hi = max(0, at - OVERLAP), min(len(data), at + PART_BYTES + OVERLAP)
                    part.append((d, lo, data[lo:hi], at, at + PART_BYTES))
                    size += hi - lo
                    if size >= PART_BYTES:
                        flush()
            flush()
            if not found:
                continue
            doc, pos, codes = (np.concatenate(x, axis=-1) for x in zip(*found))
            del found[:]
            order = _in_order(codes, ids[doc])
            starts = np.flatnonzero(_runs(*codes[:, order]))
            own = ids[doc[order]]
            later = np.zeros(len(doc), bool)
            later[order] = own > np.repeat(own[starts], np.diff(np.append(starts, len(doc))))
            del order, own
            rows = [(int(a % parts), -1, a, k, s, None, None, None, None, None) for a, k, s in _covered(doc[later], pos[later], ids, keys)]
            codes, doc, pos = codes[:, ~later], doc[~later], pos[~later]
            gram = codes[0].astype(np.int64)
            to = gram % parts * cells + gram // parts % cells
            # Small numbers are sorted by their digits.
            order = np.argsort(to.astype(np.uint16) if parts * cells <= 1 << 16 else to, kind="stable")
            codes, doc, pos, to = codes[:, order], doc[order], pos[order], to[order]
            bounds = np.flatnonzero(_runs(to)) if len(to) else []
            for a, b in zip(bounds, np.append(bounds[1:], len(to)) if len(bounds) else []):
                used, at = np.unique(doc[a:b], return_inverse=True)
                rows.append((
                    int(to[a] // cells), int(to[a] % cells), None, None, None, codes[:, a:b].tobytes(), at.astype(np.uint32).tobytes(), pos[a:b].astype(np.uint64).tobytes(),
                    ids[used].tobytes(), keys[used].tobytes(),
                ))
            if rows:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in _SENT.split(", ")])

    return send


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(col, kinds[c.split()[1]]) for col, c in zip(columns, schema.split(", "))], names=names)


def _anchor_rows(kind: int, codes: np.ndarray, own: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Anchors as rows of ``_FOUND``."""
    for at in range(0, len(pos), 50_000):
        part = slice(at, at + 50_000)
        columns = [np.full(len(pos[part]), kind, np.int32), own[part], keys[part], None, codes[0, part], pos[part], *codes[1:, part]]
        arrays = [pa.nulls(len(pos[part]), pa.binary()) if c is None else pa.array(c if c.dtype == np.int32 else c.astype(np.int64)) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _FOUND.split(", ")])


def _span_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        yield _table([(0, *row, *[None] * 6) for row in rows[at:at + 10_000]], _FOUND)


class Cell:
    """The anchors of some grams, at most ``limit`` of them and those of one more batch.

    Above that the commonest grams are handed out, those held and all that
    follow, until half of the limit is left.
    """

    def __init__(self, number: int, limit: int):
        self.number, self.limit, self.crowded = number, limit, np.empty(0, np.uint32)
        self.codes, self.doc, self.pos, self.ids, self.keys = [], [], [], [], []
        self.size = self.docs = 0

    def add(self, r: dict) -> Iterator[pa.RecordBatch]:
        ids, keys = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["keys"], np.int64)
        codes, doc = np.frombuffer(r["codes"], np.uint32).reshape(5, -1), np.frombuffer(r["doc"], np.uint32)
        pos = np.frombuffer(r["pos"], np.uint64).astype(np.int64)
        if len(self.crowded):
            out = np.isin(codes[0], self.crowded)
            yield from _anchor_rows(2, codes[:, out], ids[doc[out]], keys[doc[out]], pos[out])
            used, doc = np.unique(doc[~out], return_inverse=True)
            codes, pos, ids, keys = codes[:, ~out], pos[~out], ids[used], keys[used]
        self.hold(codes, doc.astype(np.int64) + self.docs, pos, ids, keys)
        if self.size > self.limit:
            yield from self.hand_out()

    def hold(self, codes, doc, pos, ids, keys) -> None:
        for held, new in zip((self.codes, self.doc, self.pos, self.ids, self.keys), (codes, doc, pos, ids, keys)):
            held.append(new)
        self.size += len(pos)
        self.docs += len(ids)

    def taken(self) -> list[np.ndarray]:
        out = [np.concatenate(x, axis=-1) for x in (self.codes, self.doc, self.pos, self.ids, self.keys)]
        self.codes, self.doc, self.pos, self.ids, self.keys = [], [], [], [], []
        self.size = self.docs = 0
        return out

    def hand_out(self) -> Iterator[pa.RecordBatch]:
        codes, doc, pos, ids, keys = self.taken()
        grams, counts = np.unique(codes[0], return_counts=True)
        order = np.argsort(-counts, kind="stable")
        left = len(pos) - np.cumsum(counts[order])
        common = grams[order[: int(np.searchsorted(-left, -(self.limit // 2))) + 1]]
        self.crowded = np.union1d(self.crowded, common)
        out = np.isin(codes[0], common)
        yield from _anchor_rows(2, codes[:, out], ids[doc[out]], keys[doc[out]], pos[out])
        used, doc = np.unique(doc[~out], return_inverse=True)
        self.hold(codes[:, ~out], doc, pos[~out], ids[used], keys[used])

    def decided(self) -> Iterator[pa.RecordBatch]:
        """Contexts covered by a smaller document, and anchors whose contexts are to be compared."""
        if not self.size:
            return
        codes, doc, pos, ids, keys = self.taken()
        order = _in_order(codes, ids[doc])
        codes, doc, pos = codes[:, order], doc[order], pos[order]
        del order
        own = ids[doc]
        contexts = np.flatnonzero(_runs(*codes))
        sizes = np.diff(np.append(contexts, len(doc)))
        least = own[contexts]
        later = own > np.repeat(least, sizes)
        grams = np.flatnonzero(_runs(codes[0, contexts]))
        # Only contexts of a gram that has several can share a half.
        some = np.flatnonzero(np.repeat(np.diff(np.append(grams, len(contexts))) > 1, np.diff(np.append(grams, len(contexts)))))
        gram, first = codes[0, contexts[some]].astype(np.uint64) << _U(32), least[some]
        mixed = np.zeros(len(contexts), bool)
        for side in (1, 2) if len(some) else ():
            half = codes[side, contexts[some]]
            group = np.unique(gram | half, return_inverse=True)[1]
            lowest, highest = np.full(group.max() + 1, _LARGEST), np.full(group.max() + 1, -_LARGEST - 1)
            np.minimum.at(lowest, group, first)
            np.maximum.at(highest, group, first)
            mixed[some] |= (half != 0) & (lowest[group] < highest[group])
        yield from _span_rows(list(_covered(doc[later], pos[later], ids, keys)))
        asked = np.repeat(mixed, sizes) & ~later
        yield from _anchor_rows(1, codes[:, asked], own[asked], keys[doc[asked]], pos[asked])


def _decided(limit: int):
    """What the cells of a part tell, which come one after another.

    Kind 0: spans of a document.  Kind 1: an anchor whose context is wanted.
    Kind 2: an anchor of a gram that is too common for its cell.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = Cell(-1, limit)
        for batch in batches:
            spans = []
            for r in batch.to_pylist():
                if r["spans"] is not None:
                    spans.append((r["id"], r["key"], r["spans"]))
                    continue
                if r["cell"] != cell.number:
                    yield from cell.decided()
                    cell = Cell(r["cell"], limit)
                yield from cell.add(r)
            yield from _span_rows(spans)
        yield from cell.decided()

    return decide


def _crowded(anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same decisions for anchors of very common grams, by aggregates: spans, and anchors to compare.

    Contexts and halves are grouped with partial minima, so a group is one row
    of each task before it is shuffled.
    """
    codes = ["h", "left", "right", "upper", "lower"]
    contexts = cut_lineage(anchors.groupBy(*codes).agg(F.min("id").alias("least")))

    def mixed(side: str) -> DataFrame:
        halves = contexts.filter(F.col(side) != 0).groupBy("h", side).agg(F.min("least").alias("lowest"), F.max("least").alias("highest"))
        return contexts.join(halves.filter("lowest < highest"), ["h", side], "left_semi").select(*codes)

    wanted = mixed("left").unionByName(mixed("right")).distinct()
    judged = anchors.join(contexts, codes)
    covered = judged.filter("id > least").select("id", "key", (F.col("pos") - BEFORE).alias("from"))
    asked = judged.filter("id = least").join(wanted, codes, "left_semi").select("id", "key", "h", "pos")
    return covered.mapInArrow(_even_spans(CONTEXT), _SPANS), asked


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    pack = zstandard.ZstdCompressor(level=3).compress
    return pd.Series([pack(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            data = unpack(r["packed"])
            for a in r["asks"]:
                lo = max(0, a["pos"] - BEFORE)
                rows.append((a["h"], r["id"], r["key"], a["pos"], a["pos"] - lo, data[lo:a["pos"] + LENGTH]))
        if rows:
            yield _table(rows, _CONTEXTS)


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks, of one shape."""
    return np.unique(high.astype(np.uint64) << _U(32) | low.astype(np.uint64), return_inverse=True)[1].reshape(high.shape)


class SuffixArray:
    """Enhanced suffix array of contexts, from the suffixes that have ``LENGTH`` bytes.

    ``context`` and ``start`` of the suffixes in order, ``common`` the length
    of the prefix a suffix shares with the one before it, if that is at least
    ``LENGTH``, else 0.  Suffixes are left out whose first ``LENGTH`` bytes
    occur in documents of one id only, or have one and the same byte to their
    left everywhere: the repeat that starts there is part of one that starts
    further left.
    """

    def __init__(self, contexts: list[bytes], before: np.ndarray, docs: np.ndarray):
        n = len(contexts)
        sizes = np.array([len(c) for c in contexts])
        width = CONTEXT + 8
        text = np.zeros((n, width), np.uint8)
        flat = np.frombuffer(b"".join(contexts), np.uint8)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        text[np.repeat(np.arange(n), sizes), at] = flat
        words = np.zeros((n, CONTEXT), np.uint64)
        for k in range(8):
            words = words << _U(8) | text[:, k:k + CONTEXT]
        rank = np.unique(words, return_inverse=True)[1].reshape(words.shape)
        rank = _ranks(rank[:, : CONTEXT - 8], rank[:, 8:])
        rank = _ranks(rank[:, : CONTEXT - 24], rank[:, 16:CONTEXT - 8])
        rank = _ranks(rank[:, :WINDOWS], rank[:, LENGTH - 32:LENGTH - 32 + WINDOWS])
        start = np.arange(WINDOWS)[None, :]
        ok = (start <= before[:, None]) & (start + LENGTH <= sizes[:, None])
        context, start = np.nonzero(ok)
        rank = rank[context, start]
        left = np.where(start > 0, text[context, np.maximum(start - 1, 0)].astype(np.int64), -1)
        order = np.argsort(rank, kind="stable")
        context, start, rank, left = context[order], start[order], rank[order], left[order]
        if len(rank):
            heads = np.flatnonzero(_runs(rank))
            sizes_of = np.diff(np.append(heads, len(rank)))
            doc = docs[context]
            apart = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
            edges = np.minimum.reduceat(left, heads) < 0
            diverse = edges | (np.minimum.reduceat(left, heads) != np.maximum.reduceat(left, heads))
            keep = np.repeat(apart & diverse, sizes_of)
            context, start, rank, left = context[keep], start[keep], rank[keep], left[keep]
        # What follows the first LENGTH bytes, in words that compare like bytes.
        tail = np.zeros((len(rank), 32), np.uint8)
        for k in range(CONTEXT - LENGTH):
            tail[:, k] = text[context, np.minimum(start + LENGTH + k, width - 1)]
        keys = tail.view(">u8").astype(np.uint64)
        order = np.lexsort((keys[:, 3], keys[:, 2], keys[:, 1], keys[:, 0], rank))
        self.context, self.start, self.left = context[order], start[order], left[order]
        rank, tail = rank[order], tail[order]
        self.size = sizes[self.context] - self.start
        self.common = np.zeros(len(rank), np.int64)
        if len(rank) > 1:
            differs = tail[1:] != tail[:-1]
            extra = np.where(differs.any(axis=1), differs.argmax(axis=1), CONTEXT - LENGTH)
            length = np.minimum(LENGTH + extra, np.minimum(self.size[1:], self.size[:-1]))
            self.common[1:] = np.where(rank[1:] == rank[:-1], length, 0)

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """``length, first, last`` of the intervals of suffixes that share a maximal repeat.

        Intervals lie within each other or apart.  The stack holds those that
        are open, with what is to their left: a byte, or -2 once it differs
        (a place whose left byte is not known differs from all).
        """
        common, left = self.common.tolist(), [-2 if x < 0 else x for x in self.left.tolist()]
        stack: list[list[int]] = []  # length, first, left
        for i in range(1, len(common) + 1):
            length = common[i] if i < len(common) else 0
            first, seen = i - 1, left[i - 1]
            while stack and stack[-1][0] > length:
                top = stack.pop()
                top[2] = top[2] if top[2] == seen else -2
                if top[2] == -2:
                    yield top[0], top[1], i - 1
                first, seen = top[1], top[2]
            if length:
                if stack and stack[-1][0] == length:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else -2
                else:
                    stack.append([length, first, seen])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that smaller documents cover, from contexts sorted by anchor."""

    def scan(rows: list[dict]) -> pa.RecordBatch | None:
        docs = np.array([r["id"] for r in rows])
        array = SuffixArray([r["bytes"] for r in rows], np.array([r["before"] for r in rows]), docs)
        doc, longest = docs[array.context], np.zeros(len(array.context), np.int64)
        for length, first, last in array.maximal_repeats():
            of = slice(first, last + 1)
            longest[of] = np.maximum(longest[of], np.where(doc[of] > doc[of].min(), length, 0))
        out = []
        at = np.flatnonzero(longest)
        for c, s, n in zip(array.context[at].tolist(), array.start[at].tolist(), longest[at].tolist()):
            r = rows[c]
            start = r["pos"] - r["before"] + s
            out.append((r["id"], r["key"], np.array([start, start + n], "<i8").tobytes()))
        return _table(out, _SPANS) if out else None

    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if len(held) >= ARRAY_CONTEXTS and r["h"] != held[-1]["h"]:
                done = scan(held)
                held = []
                if done is not None:
                    yield done
            held.append(r)
    if held and (done := scan(held)) is not None:
        yield done


def _windows(contexts: DataFrame) -> DataFrame:
    """The same for anchors of very many contexts, by grouping windows: no group is gathered."""
    place = F.explode(F.sequence(F.lit(0), F.least("before", F.octet_length("bytes") - LENGTH))).alias("start")
    windows = contexts.filter(F.octet_length("bytes") >= LENGTH).select("*", place).select(
        "id", "key", (F.col("pos") - F.col("before") + F.col("start")).alias("from"), F.sha2(F.substring("bytes", F.col("start") + 1, F.lit(LENGTH)), 256).alias("window"))
    least = windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most")
    return windows.join(least, "window").filter("id > least").select("id", "key", "from").mapInArrow(_even_spans(LENGTH), _SPANS)


def _even_spans(width: int):
    def spans_from(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            spans = np.stack([at, at + width], axis=1).astype("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.tobytes() for s in spans], pa.binary())], names=["id", "key", "spans"])

    return spans_from


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            data = unpack(r["packed"])
            n, spans = len(data), np.empty((0, 2), np.int64)
            if r["spans"]:
                spans = np.frombuffer(b"".join(r["spans"]), "<i8").reshape(-1, 2)
                spans = merged(np.clip(spans, 0, n))
            kept, at = [], 0
            for a, b in spans.tolist():
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            left = b"".join(kept)
            rows.append((None if r["none"] else r["id"], n, n - len(left), len(spans), hashlib.sha256(left).hexdigest(), left))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


_APPLIED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def deduplicated(docs: DataFrame, hot_contexts: int = HOT_CONTEXTS, cell_anchors: int = CELL_ANCHORS, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row of ``doc_id, text``.

    Null texts are empty.  A null id is larger than any other.  Rows of equal
    id do not take bytes of each other; rows that agree in id and text have one
    result.  An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    none = F.col("doc_id").isNull()
    read = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LARGEST)).alias("id"), F.xxhash64(whole_text(), none).alias("key"), none.alias("none"), whole_text().alias("text"))
    size = docs.agg(F.sum(F.octet_length(whole_text())).alias("n")).first()["n"] or 0
    cells = size // (cell_bytes * parts) + 1
    sent = read.select("id", "key", "text").mapInArrow(_sent(parts, cells), _SENT)
    found = cut_lineage(sent.repartitionById(parts, F.col("part")).sortWithinPartitions("cell").mapInArrow(_decided(cell_anchors), _FOUND))
    asked = found.filter("kind = 1").select("id", "key", "h", "pos")
    covered = found.filter("kind = 0").select("id", "key", "spans")
    crowded = found.filter("kind = 2").drop("kind", "spans")
    if not crowded.isEmpty():
        more, wanted = _crowded(crowded)
        asked, covered = cut_lineage(asked.unionByName(wanted)), covered.unionByName(more)
    hot = cut_lineage(asked.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_contexts).select("h", F.lit(True).alias("hot")))
    asks = asked.groupBy("id", "key").agg(F.collect_set(F.struct("h", "pos")).alias("asks"))
    # Both joins below use this, so that Spark shuffles the texts once.
    texts = read.select("id", "key", "none", _packed("text").alias("packed")).repartition("id", "key")
    once = texts.join(asks, ["id", "key"]).select("id", "key", "none", "packed", "asks")
    contexts = once.mapInArrow(_contexts, _CONTEXTS)
    any_hot = not hot.isEmpty()
    gathered = contexts.join(hot, "h", "left_anti") if any_hot else contexts
    repeats = gathered.repartition("h").sortWithinPartitions("h").mapInArrow(_repeats, _SPANS)
    if any_hot:
        repeats = repeats.unionByName(_windows(contexts.join(hot, "h", "left_semi")))
    spans = covered.unionByName(repeats).groupBy("id", "key").agg(F.collect_list("spans").alias("spans"))
    return texts.join(spans, ["id", "key"], "left").select("id", "none", "packed", "spans").mapInArrow(_applied, _APPLIED)
