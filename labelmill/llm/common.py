"""What several operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The characters that separate words, for trimming.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """64-bit hash that tells rows of one id apart by their text."""
    return F.xxhash64(whole_text(name))


#: Rows, and bytes unless a single row has more, that tasks in Python take at once; what they keep besides is bounded.
SLICE_ROWS = 10_000
SLICE_BYTES = 16_000_000


def slices(batches: Iterable[pa.Array], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Arrow arrays or batches in parts of at most ``rows`` rows and ``size`` bytes."""
    for batch in batches:
        if len(batch) > rows or (len(batch) > 1 and batch.nbytes > size):
            half = (len(batch) + 1) // 2
            yield from slices([batch.slice(0, half), batch.slice(half)], rows, size)
        elif len(batch):
            yield batch


def coded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of texts, which of them the words are in a row, and where each text's words start (one more for the end).

    Words are runs of anything but ASCII white space.  White space at an end
    of a text gives an empty word.
    """
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), (offsets - offsets[0]).astype(np.int64)


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The same with the different words as strings of Python."""
    words, codes, starts = coded_words(texts)
    return words.to_pylist(), codes, starts


def picked(ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the items of ``which`` lists, one list after another, and where each starts (one more for the end).

    List ``k`` has the items from ``ends[k - 1]`` to ``ends[k]``.
    """
    starts = np.concatenate([[0], ends[:-1]])
    sizes = (ends - starts)[which]
    to = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(to[-1]) + np.repeat(starts[which] - to[:-1], sizes), to
