"""Helpers that keep the operators safe on large and skewed inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with more rows than this is joined by broadcast instead of a shuffle,
# so at most (rows / HOT_ROWS) keys are ever broadcast.
HOT_ROWS = 1_000_000

# Bits of a row id that hold the place within a partition.
PLACE_BITS = 33

# Up to this many first rows are merged in one task.
MERGE_ROWS = 1_000


def dim(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small dimension table from driver values, as a local relation: its exact
    size is known to the optimizer, which decides itself whether to broadcast."""
    struct = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in struct]
    if not rows:
        return spark.createDataFrame([], struct)
    table = pa.table({f.name: pa.array(list(col)) for f, col in zip(struct, columns)})
    return spark.createDataFrame(table, struct)


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that all executors see."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="labelmill-")
    context.setCheckpointDir(own)
    return own


def run_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables below the shared one."""
    return f"{shared_dir(spark)}/labelmill/{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables, once no result needs them
    any more; tells whether there were any.  Other applications' stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Survives lost executors and freezes row placement.  Unlike a checkpoint the
    table is columnar, and the optimizer knows its size.  Whole jobs end with
    :func:`clear_run`.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def explode_rows(df: DataFrame, keep: Sequence[str], values: Column | str, name: str) -> DataFrame:
    """Elements of an array column as rows, none for empty arrays.

    A plain ``explode`` of a computed column makes the optimizer filter on the
    array's size below it, which evaluates the array a second time.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key.  ``order`` has to be total.  The rank filter
    lets Spark cut every group to ``k`` rows before the shuffle."""
    name = rank or "__rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank over the whole table without a single-task window.

    Rows are range-partitioned and sorted, numbered in place as they are written,
    and counted per partition; so they are shuffled once.  The offsets table
    has one row per partition.  Range partitioning samples its input first, so
    expensive rows are best written before (see :func:`cut_lineage`).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A row id has the partition in its upper bits and the place in it in the lower ones.
    placed = cut_lineage(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__seq", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__seq", PLACE_BITS), F.col("__seq").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    )
    return (
        placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__base") + inside + 1).drop("__part", "__base", "__seq")
    )


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows in a total order.

    Few rows are kept per task and merged; many rows are ranked by range
    partitions instead, so that no task has to hold or merge all of them.
    """
    if n <= MERGE_ROWS:
        return df.orderBy(*order).limit(n)
    return global_rank(df, order, "__n").filter(F.col("__n") <= n).drop("__n")


def join_by_key(df: DataFrame, stats: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of rows with one-row-per-key ``stats``.

    ``stats[count]`` is the number of rows of ``df`` under that key.  Keys above
    ``hot_rows`` are few by arithmetic, so they are broadcast and their rows
    never meet in one task; all other keys go through a normal shuffle join.
    """
    hot = stats.filter(F.col(count) > hot_rows).withColumn("__hot", F.lit(True))
    cold = stats.filter(F.col(count) <= hot_rows)
    marked = df.join(F.broadcast(hot), key, "left")
    names = [*df.columns, *[c for c in stats.columns if c != key]]
    of_hot = marked.filter(F.col("__hot")).select(*names)
    of_cold = marked.filter(F.col("__hot").isNull()).select(*df.columns).join(cold, key)
    return of_hot.unionByName(of_cold.select(*names))
