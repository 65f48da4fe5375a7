"""Dropping lines that many documents share.

Every line becomes a row of its key's 128-bit hash, document and position.  The
rows are range-partitioned by (hash, document), so a line that a third of all
documents holds is spread over many tasks, and sorted by (hash, document,
position).  One pass over a sorted partition counts the documents of each hash
and lets the lines of frequent hashes go.  Only the first and the last hash of
a partition can go on in another one; their counts are added up afterwards,
from two rows a partition.  What comes out is a compressed bitmap of kept
lines per document; texts are not shuffled before it is applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import text_key, whole_text
from labelmill.operators.scale import cut_lineage

MIN_DOCS = 10
MIN_CHARS = 1

_SPACE = b" \t\n\x0b\x0c\r"

#: Kinds of rows that the pass over sorted lines gives.
DROP, OPEN, COUNT, FIRST = 0, 1, 2, 3

_LINES = "h1 long, h2 long, doc_id long, text_key long, pos int, n_lines int"
_FOUND = "kind int, h1 long, h2 long, doc_id long, text_key long, pos int, n_lines int, n_docs long"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(_SPACE).lower()


def _hashed(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            digests, rows, counts = [], [], []
            for i, text in enumerate(texts):
                parts = text.encode("utf-8", "surrogatepass").split(b"\n")
                for pos, line in enumerate(parts):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append((i, pos))
                counts.append(len(parts))
            if not rows:
                continue
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            at = np.array(rows, dtype=np.int64)
            ids = pa.array(docs, pa.int64()).take(pa.array(at[:, 0]))
            yield pa.RecordBatch.from_arrays([
                pa.array(h[:, 0]), pa.array(h[:, 1]), ids, pa.array(np.array(keys, dtype=np.int64)[at[:, 0]]),
                pa.array(at[:, 1].astype(np.int32)), pa.array(np.array(counts, dtype=np.int32)[at[:, 0]]),
            ], names=["h1", "h2", "doc_id", "text_key", "pos", "n_lines"])

    return lines


def _stream(min_docs: int, keep_first: bool):
    """One pass over lines sorted by hash, document and position.

    Whole hashes of a batch are decided at once; the last hash of a batch is
    carried on.  A carried hash that has reached ``min_docs`` documents lets its
    rows go and keeps only its count, so the carried rows stay few.
    """

    def changes(*columns: np.ndarray) -> np.ndarray:
        out = np.ones(len(columns[0]), dtype=bool)
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
        return out

    def found(frame: pd.DataFrame, kind, n_docs=0) -> pd.DataFrame:
        return frame.assign(kind=np.int32(kind), n_docs=np.int64(n_docs))[["kind", "h1", "h2", "doc_id", "text_key", "pos", "n_lines", "n_docs"]]

    class Boundary:
        """The hash that a partition begins or ends with; it may have rows elsewhere."""

        def __init__(self, rows: pd.DataFrame):
            self.h, self.rows, self.n, self.last = (rows.h1.iat[0], rows.h2.iat[0]), [], 0, None
            self.first = rows.iloc[:1]

        def add(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            doc, key = rows.doc_id.fillna(0).to_numpy(), rows.text_key.to_numpy()
            missing = rows.doc_id.isna().to_numpy()
            new = changes(doc, missing, key)
            new[0] = self.last != (doc[0], missing[0], key[0])
            self.n += int(new.sum())
            self.last = (doc[-1], missing[-1], key[-1])
            if keep_first and not self.rows and rows.index[0] == self.first.index[0] and rows.pos.iat[0] == self.first.pos.iat[0]:
                rows = rows.iloc[1:]
            self.rows.append(rows)
            if self.n >= min_docs:
                yield from (found(r, DROP) for r in self.rows if len(r))
                self.rows = [rows.iloc[:0]]

        def end(self) -> Iterator[pd.DataFrame]:
            yield from (found(r, OPEN) for r in self.rows if len(r))
            yield found(self.first.assign(doc_id=pd.array([pd.NA], dtype="Int64")), COUNT, self.n)
            if keep_first:
                yield found(self.first, FIRST)

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, began = None, False  # the hash that may go on; whether a first hash was met
        offset = 0
        for frame in frames:
            if not len(frame):
                continue
            frame = frame.astype({"doc_id": "Int64"})
            frame.index = np.arange(offset, offset + len(frame))
            offset += len(frame)
            starts = np.flatnonzero(changes(frame.h1.to_numpy(), frame.h2.to_numpy()))
            if held is not None:
                n = starts[1] if len(starts) > 1 else len(frame)
                if held.h == (frame.h1.iat[0], frame.h2.iat[0]):
                    yield from held.add(frame.iloc[:n])
                    frame, starts = frame.iloc[n:], starts[1:] - n
                    if not len(frame):
                        continue
                yield from held.end() if held.edge else held.close()
            edge = not began
            began = True
            if edge and len(starts) > 1:  # the first hash of the partition, ended here
                first = Boundary(frame)
                yield from first.add(frame.iloc[: starts[1]])
                yield from first.end()
                frame, starts = frame.iloc[starts[1]:], starts[1:] - starts[1]
                edge = False
            inner = frame.iloc[: starts[-1]]
            if len(inner):
                yield from whole(inner, starts[:-1])
            tail = frame.iloc[starts[-1]:]
            held = Held(tail, edge)
            yield from held.add(tail)
        if held is not None:
            yield from held.end()

    class Held(Boundary):
        def __init__(self, rows: pd.DataFrame, edge: bool):
            super().__init__(rows)
            self.edge = edge

        def close(self) -> Iterator[pd.DataFrame]:
            """The hash ended inside the partition, so its count is final: rows still open stay."""
            return iter(())

    def whole(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        doc, key = frame.doc_id.fillna(0).to_numpy(), frame.text_key.to_numpy()
        new = changes(frame.h1.to_numpy(), frame.h2.to_numpy(), doc, frame.doc_id.isna().to_numpy(), key)
        n = np.add.reduceat(new.astype(np.int64), starts)
        drop = np.repeat(n >= min_docs, np.diff(np.append(starts, len(frame))))
        if keep_first:
            drop[starts] = False
        if drop.any():
            yield found(frame[drop], DROP)

    return stream


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
    def bits(n, lines):
        keep = np.ones(n, dtype=bool)
        keep[np.asarray(lines, dtype=np.int64)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return pd.Series([bits(n, lines) for n, lines in zip(n_lines, dropped)])


def kept_lines(text: str, bitmap: bytes | None) -> str:
    """The lines of a text whose bits are set, joined again."""
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return "\n".join(line for line, bit in zip(lines, keep) if bit)


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    return pd.Series([kept_lines(t, b) for t, b in zip(text, bitmap)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False) -> DataFrame:
    """``doc_id, text_key, n_lines, n_dropped, keep_bitmap`` of every document that loses lines.

    A line goes if its key has at least ``min_chars`` code points and lies in
    at least ``min_docs`` documents; with ``keep_first`` its first occurrence,
    by document and position, stays.  Null and empty texts are one empty line,
    whose key is too short to be found.  Rows that agree in id and text are one
    document; rows that agree in the id only are different ones; a null id is
    an id.  An empty table gives no rows.  Other columns are not read.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), whole_text().alias("text"))
    lines = cut_lineage(read.mapInArrow(_hashed(min_chars), _LINES))
    placed = lines.repartitionByRange("h1", "h2", "doc_id", "text_key").sortWithinPartitions("h1", "h2", "doc_id", "text_key", "pos")
    found = cut_lineage(placed.mapInPandas(_stream(min_docs, keep_first), _FOUND))
    frequent = (
        found.filter(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"))
        .filter(F.col("n") >= min_docs).drop("n")
    )
    names = ["doc_id", "text_key", "pos", "n_lines"]
    late = found.filter(F.col("kind") == OPEN).join(frequent, ["h1", "h2"]).select(*names)
    dropped = found.filter(F.col("kind") == DROP).select(*names).unionByName(late)
    if keep_first:
        rows = found.filter(F.col("kind") == FIRST).join(frequent, ["h1", "h2"])
        least = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("least"))
        later = rows.join(least, ["h1", "h2"]).filter(~F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("least")))
        dropped = dropped.unionByName(later.select(*names))
    return (
        dropped.groupBy("doc_id", "text_key").agg(F.first("n_lines").cast("long").alias("n_lines"), F.collect_set("pos").alias("lines"))
        .select("doc_id", "text_key", "n_lines", F.size("lines").cast("long").alias("n_dropped"), _bitmap("n_lines", "lines").alias("keep_bitmap"))
    )


def with_kept_text(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (null text: empty), ``n_lines`` and ``n_dropped``."""
    names = [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]
    right = bitmaps.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key2"), F.col("n_dropped").alias("__dropped"), "keep_bitmap")
    left = docs.select(*names).withColumn("__text", whole_text()).withColumn("__key", text_key())
    joined = left.join(right, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__key2")), "left")
    return joined.select(
        *names, _kept("__text", "keep_bitmap").alias("kept"),
        (F.regexp_count("__text", F.lit("\n")) + 1).cast("long").alias("n_lines"),
        F.coalesce("__dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """Documents with the columns of ``docs`` and their kept lines as text.

    Texts that lose no line stay as they are, null ones too; ``n_chars``,
    where there is one, follows the text.
    """
    kept = with_kept_text(docs, keep_bitmaps(docs, **options))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text"))
    out = kept.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
