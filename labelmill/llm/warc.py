"""WARC archives as seekable Zstandard bundles.

A task writes its records to bundles (``.warc.zst``).  A bundle is a row of
independent Zstandard frames with whole records each, so a frame decompresses
on its own, and ends with a seek table in a skippable frame, as the public
seekable format has it.  The index maps every record to its bundle, frame,
offset within the frame's decompressed bytes, and length.

Bundles go to a folder that all executors share, through ``pyarrow.fs``.  Each
attempt of a task writes files of its own name, and the index, written by
Spark's committer, names those of the attempt that counts; so a lost executor
leaves at most files that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.scale import cut_lineage, shared_dir

#: Payloads of fewer bytes are always stored.
MIN_REVISIT_BYTES = 1000

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3

#: Frames that a task reads back.
TASK_FRAMES = 32

# Fixed values of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "page_id long, record_id string, record_type string, bundle string, frame int, offset long, length long"
_RECORD = (
    "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
    "payload binary, bundle string, frame int, offset long, length long"
)


@dataclass
class Archive:
    folder: str
    index: DataFrame


def filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def marked(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to``.

    ``refers_to`` is the largest page id with the same payload, where that is
    another page and the payload has ``min_bytes``.  The largest id per payload
    is found by SHA-256 from narrow rows, combined before the shuffle; only
    payloads of several rows are joined back.
    """
    read = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    sized = read.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    repeated = (
        sized.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.sha2("payload", 256).alias("__same"))
        .agg(F.max("page_id").alias("__largest"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    )
    return (
        sized.withColumn("__same", F.sha2("payload", 256)).join(repeated, "__same", "left")
        .withColumn("payload_digest", F.sha1("payload"))
        .withColumn("refers_to", F.when(~F.col("__largest").eqNullSafe(F.col("page_id")), F.col("__largest")))
        .select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")
    )


def record_id(page_id: int | None, digest: str) -> str:
    """Name of a page's record: the same on every run, and known to those that refer to it."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16])}"


def _one_line(text: str) -> str:
    return "".join(c if c.isprintable() and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def _whole_line(text: str) -> str:
    from urllib.parse import unquote

    return unquote(text, errors="surrogatepass")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> tuple[str, str, bytes]:
    """Record id, type and bytes.  A revisit has no block; its headers tell the payload's size and digest."""
    own, kind = record_id(page_id, digest), "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{own}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to, digest)}>", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return own, kind, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(frame: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of all records of a decompressed frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        first, *lines = frame[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no record at {at}: {first[:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines)
        block = end + 4
        after = block + int(headers["Content-Length"])
        if frame[after:after + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} has no end")
        yield headers, frame[block:after], at, after + 4 - at
        at = after + 4


class BundleWriter:
    """One bundle: frames as they fill up, then the seek table."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        fs, path = filesystem(f"{folder}/{self.name}")
        self.out, self.frame_bytes = fs.open_output_stream(path, compression=None), frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries, self.parts, self.filled, self.written = [], [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in it of the record."""
        if self.filled and self.filled + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.entries), self.filled
        self.parts.append(data)
        self.filled += len(data)
        return place

    def flush(self) -> None:
        if self.parts:
            raw = b"".join(self.parts)
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.entries.append((len(packed), len(raw)))
            self.written += len(packed)
            self.parts, self.filled = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *e) for e in self.entries) + struct.pack("<IBI", len(self.entries), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, found through the seek table at its end."""

    def __init__(self, path: str):
        fs, inner = filesystem(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC or flags & 0x80:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        self.entries = list(struct.iter_unpack("<II", self.file.read(8 * n)))
        self.starts = [0]
        for packed, _ in self.entries:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.starts[k])
        packed, raw = self.entries[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=raw)


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, level: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, rows = None, []
        for frame in frames:
            for page_id, url, payload, digest, refers_to in zip(
                frame.page_id.astype("Int64"), frame.url, frame.payload, frame.payload_digest, frame.refers_to.astype("Int64"),
            ):
                page_id, refers_to = (None if v is pd.NA else int(v) for v in (page_id, refers_to))
                if bundle is not None and bundle.written + bundle.filled > bundle_bytes:
                    bundle.close()
                    bundle = None
                if bundle is None:
                    bundle = BundleWriter(folder, frame_bytes, level)
                own, kind, data = record(page_id, url, bytes(payload), digest, refers_to)
                rows.append((page_id, own, kind, bundle.name, *bundle.add(data), len(data)))
        if bundle is not None:
            bundle.close()
            # Only now: a row of the index stands for a bundle that is whole.
            for at in range(0, len(rows), 10_000):
                part = pd.DataFrame(rows[at:at + 10_000], columns=["page_id", "record_id", "record_type", "bundle", "frame", "offset", "length"])
                yield part.astype({"page_id": "Int64"})

    return write


def write_archive(
    pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_REVISIT_BYTES,
    frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL,
) -> Archive:
    """Write a record per row of ``pages`` (``page_id, url, html``) and return the index.

    Null html is an empty payload; a null url leaves its header out; a null
    page id is smaller than any other.  Rows that share the largest page id of
    a payload are all responses.  Repeated rows give records of the same name.
    An empty table gives an empty index and no bundle.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/labelmill/warc-{uuid.uuid4().hex}"
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    index = cut_lineage(marked(pages, min_bytes).mapInPandas(_writer(folder, frame_bytes, bundle_bytes, level), _INDEX))
    return Archive(folder, index)


def _rows(records: Iterable[tuple], payload: bool) -> pd.DataFrame:
    out = []
    for headers, block, bundle, frame, offset, length in records:
        kind = headers["WARC-Type"]
        page, url, refers = (headers.get(k) for k in ("WARC-Page-ID", "WARC-Target-URI", "WARC-Refers-To-Page-ID"))
        digest = hashlib.sha1(block).hexdigest() if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = len(block) if kind == "response" else int(headers["WARC-Payload-Length"])
        out.append((
            headers["WARC-Record-ID"].strip("<>"), None if page is None else int(page), None if url is None else _whole_line(url), kind,
            None if refers is None else int(refers), size, digest, block if payload else None, bundle, frame, offset, length,
        ))
    names = [part.split()[0] for part in _RECORD.split(", ")]
    return pd.DataFrame(out, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archive(archive: Archive, payload: bool = True) -> DataFrame:
    """All records of the bundles that the index names, frame by frame.

    A task reads the frames given to it and nothing else; the payload of a
    revisit is that of the record it refers to, so only its size and digest are
    told.  ``payload=False`` leaves the blocks out.
    """
    folder = archive.folder

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bundle, numbers in frame.groupby("bundle", sort=False)["frame"]:
                reader = BundleReader(f"{folder}/{bundle}")
                for k in sorted(numbers):
                    yield _rows(((h, b, bundle, k, at, n) for h, b, at, n in parse(reader.frame(k))), payload)

    frames = archive.index.select("bundle", "frame").distinct()
    # A row stands for a frame of work, so the number of tasks goes by rows.
    return frames.repartition(max(1, frames.count() // TASK_FRAMES), "bundle", "frame").mapInPandas(read, _RECORD)


def fetch(archive: Archive, ids: DataFrame) -> DataFrame:
    """Records by ``record_id``: through the index to the frame, and in it to the offset."""
    folder = archive.folder

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (bundle, k), places in frame.groupby(["bundle", "frame"], sort=False):
                data = BundleReader(f"{folder}/{bundle}").frame(k)
                found = []
                for offset, length in zip(places.offset, places.length):
                    headers, block, _, _ = next(parse(data[offset:offset + length]))
                    found.append((headers, block, bundle, k, offset, length))
                yield _rows(found, True)

    wanted = archive.index.join(ids.select("record_id").distinct(), "record_id")
    return wanted.select("bundle", "frame", "offset", "length").repartition("bundle", "frame").mapInPandas(read, _RECORD)
