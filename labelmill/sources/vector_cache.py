"""A stored cache of embeddings, bucketed by the content of the text.

The cache outgrows every run that reads it, so it must not be shuffled.  It is
an external table clustered by ``content_key``: only the texts of a run are
dealt to its buckets, and the buckets are read in place.  Every run appends
small files; :func:`compact` writes them anew, one file per bucket, and makes
them current at once.

Rows depend on nothing but the text and the encoder, so whatever part of an
append is there may be read, and two runs that add the same text do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.operators.scale import cut_lineage, join_by_key
from labelmill.sources.pointer import ChangedMeanwhile, current, publish, remove_parts

KEY = "content_key"
PARTS = "_buckets"
BUCKETS = 256


@dataclass(frozen=True)
class VectorCache:
    """The current version of a cache: its path, and the table over its files."""

    path: str
    table: str
    buckets: int
    version: int


def _open(spark: SparkSession, path: str, version: int, state: dict) -> VectorCache:
    folder = f"{path}/{PARTS}/{state['folder']}"
    name = f"vector_cache_{hashlib.md5(folder.encode()).hexdigest()}"
    location = folder.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({KEY} STRING, embedding ARRAY<DOUBLE>) USING parquet "
              f"CLUSTERED BY ({KEY}) INTO {state['buckets']} BUCKETS LOCATION '{location}'")
    # Other applications may have added files since.
    spark.catalog.refreshTable(name)
    return VectorCache(path, name, state["buckets"], version)


def open_cache(spark: SparkSession, path: str, encoder: str, buckets: int = BUCKETS) -> VectorCache:
    """The cache at ``path``, made empty if there is none.

    ``encoder`` names what makes the vectors; a cache of another encoder is an
    error.  ``buckets`` counts for a new cache only.
    """
    version, state = current(spark, path)
    if not state:
        state = {"folder": uuid.uuid4().hex, "buckets": buckets, "encoder": encoder}
        try:
            version = publish(spark, path, 0, state)
        except ChangedMeanwhile:
            version, state = current(spark, path)
    if state["encoder"] != encoder:
        raise ValueError(f"{path} has vectors of {state['encoder']!r}, not of {encoder!r}")
    return _open(spark, path, version, state)


def vectors(spark: SparkSession, cache: VectorCache) -> DataFrame:
    """One row (content_key, embedding) per text; texts added twice meet inside their bucket, without a shuffle."""
    return spark.table(cache.table).groupBy(KEY).agg(F.any_value("embedding").alias("embedding"))


def add(rows: DataFrame, cache: VectorCache) -> None:
    """Append (content_key, embedding) rows, at most one file per bucket; null vectors are not kept."""
    known = rows.select(KEY, F.col("embedding").cast("array<double>")).filter(F.col("embedding").isNotNull())
    known.repartition(cache.buckets, KEY).write.insertInto(cache.table)


def embed_cached(df: DataFrame, cache: VectorCache, encoder: Callable[[Column], Column], text: str = "input",
                 out: str = "embedding", cached: str = "was_cached") -> DataFrame:
    """All rows with the vector of their text, and whether it was in the cache before.

    The encoder runs once for each text that the cache lacks, and its vectors are
    added.  Null is the empty text.  A null vector is given out, but tried again
    the next time.  Rows are joined to their vectors without many rows of one
    text meeting in a task.  Columns of ``df`` named like the new ones are
    replaced.
    """
    spark = df.sparkSession
    keyed = df.drop(out, cached).withColumn("__text", F.coalesce(F.col(text), F.lit(""))).withColumn(KEY, F.md5("__text"))
    wanted = keyed.groupBy(KEY).agg(F.any_value("__text").alias("__text"), F.count(F.lit(1)).alias("__n"))
    # Dealt to the buckets by number, or the optimizer may deal the cache to the tasks of this run.
    met = wanted.repartition(cache.buckets, KEY).join(vectors(spark, cache), KEY, "left")
    lacks = F.col("embedding").isNull()
    found = cut_lineage(met.select(KEY, F.when(lacks, F.col("__text")).alias("__text"), "__n", "embedding"))
    fresh = cut_lineage(found.filter(lacks).select(KEY, "__n", encoder(F.col("__text")).cast("array<double>").alias("embedding")))
    add(fresh, cache)
    stats = found.filter(~lacks).select(KEY, "__n", F.col("embedding").alias(out), F.lit(True).alias(cached)).unionByName(
        fresh.select(KEY, "__n", F.col("embedding").alias(out), F.lit(False).alias(cached)))
    return join_by_key(keyed.drop("__text"), stats, KEY, "__n").drop(KEY, "__n")


def compact(spark: SparkSession, path: str, buckets: int | None = None) -> VectorCache:
    """Write the cache anew, one row per text and one file per bucket, and make that current.

    Readers keep the version that they opened.  What a run appends to the old
    version meanwhile is encoded again when it is next wanted.  With another
    number of ``buckets`` the rows are dealt anew, which is the only shuffle of
    a cache.
    """
    version, state = current(spark, path)
    if not state:
        raise ValueError(f"{path} is no cache")
    old = _open(spark, path, version, state)
    renewed = state | {"folder": uuid.uuid4().hex, "buckets": buckets or old.buckets}
    new = _open(spark, path, version + 1, renewed)
    rows = vectors(spark, old)
    (rows if new.buckets == old.buckets else rows.repartition(new.buckets, KEY)).write.insertInto(new.table)
    publish(spark, path, version, renewed)
    return new


def clean(spark: SparkSession, path: str) -> list[str]:
    """Delete the files of older versions, at a time when nobody uses the cache."""
    return remove_parts(spark, path, PARTS, {current(spark, path)[1].get("folder", "")})
