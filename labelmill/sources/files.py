"""Readers and writers: JSON lines, splits, logs, predictions and metrics."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.config import LabelSpec
from labelmill.functions import text as X
from labelmill.operators.corpus import corpus_schema, feedback_schema, flatten, log_schema
from labelmill.operators.validate import split_lines
from labelmill.sources.pointer import current, folder_names, publish, remove_parts

#: Folder of the writes of a stored corpus.
PARTS = "_parts"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, and a line that
    is not JSON fails the job instead of becoming a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines with their file, for strict validation: (file, value)."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")


def read_numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines with their line number: (file, line_no, value).

    Lines are numbered inside their file split, which a task reads in order, and
    the line counts of the earlier splits of the file are added.  So files of
    any size stay splittable, lines are not shuffled, and the offsets have one
    row per split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least")).select(
        "path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("base"))
    return lines.join(offsets, ["path", "block"]).select("file", (F.col("base") + F.col("seq") + 1).alias("line_no"), "value")


def split_name(file: Column) -> Column:
    return F.regexp_replace(file, r"\.jsonl?(\.gz)?\z", "")


def read_splits(spark: SparkSession, paths: Sequence[str], spec: LabelSpec, order: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Flat corpus of several split files, tagged with split, its position and line number.

    Blank lines are skipped; a malformed line fails the job."""
    lines = read_numbered_lines(spark, list(paths)).filter(X.strip(F.col("value")) != "")
    return parse_splits(lines, spec, order, "FAILFAST")


def parse_splits(lines: DataFrame, spec: LabelSpec, order: Sequence[str] = ("train", "val", "test"), mode: str = "PERMISSIVE") -> DataFrame:
    """Flat corpus rows of numbered lines (file, line_no, value), a row each.

    In ``PERMISSIVE`` mode a value of another type than its field's is null, and
    so is each field of a line that is no JSON object; ``validate_lines`` and
    ``split_lines`` name these."""
    row = F.from_json("value", corpus_schema(spec), {"mode": mode})
    tagged = lines.select(split_name(F.col("file")).alias("split"), "line_no", row.alias("row")).select("split", "line_no", "row.*")
    placed = tagged.withColumn("split_pos", F.array_position(X.label_array(order), F.col("split")))
    return flatten(placed, spec)


def read_split(spark: SparkSession, path: str, spec: LabelSpec) -> DataFrame:
    """One split as flat corpus rows: texts and targets are its columns."""
    return flatten(read_jsonl(spark, path, corpus_schema(spec)), spec)


def _or_empty(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_log(spark: SparkSession, path: str | list[str], spec: LabelSpec) -> DataFrame:
    """Log events of all paths; a log that does not exist yet is empty, and a malformed event fails the job."""
    return _or_empty(spark, path, log_schema(spec))


def read_log_lines(spark: SparkSession, path: str | list[str], spec: LabelSpec) -> tuple[DataFrame, DataFrame]:
    """Log events of all paths, and the lines that are none: (file, line_no, value, reason).

    For logs that other programs write: a line cut off in the middle, or one
    that is no event, takes nothing else with it.  An event is an object with an
    ``interaction_id`` or an ``entry_type``.
    """
    readable, unreadable = split_lines(read_numbered_lines(spark, path))
    events, strange = parse_events(readable, spec)
    return events, unreadable.unionByName(strange)


def parse_events(lines: DataFrame, spec: LabelSpec) -> tuple[DataFrame, DataFrame]:
    """Events of readable lines, and the lines without what an event needs, with a ``reason``."""
    parsed = lines.withColumn("__event", F.from_json("value", log_schema(spec)))
    needed = F.col("__event.interaction_id").isNotNull() | F.col("__event.entry_type").isNotNull()
    return parsed.filter(needed).select("__event.*"), parsed.filter(~needed).drop("__event").withColumn("reason", F.lit("not_an_event"))


def read_feedback(spark: SparkSession, path: str, spec: LabelSpec) -> DataFrame:
    return read_jsonl(spark, path, feedback_schema(spec))


def append_log(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; new files only, nothing is rewritten."""
    events.write.mode("append").option("ignoreNullFields", False).json(path)


def write_corpus(df: DataFrame, path: str) -> None:
    """Whole corpus to a new path, partitioned by split.

    Fails if the path exists: readers of the old version keep a complete table.
    """
    df.write.mode("error").partitionBy("split").json(path)


def rewrite_splits(df: DataFrame, path: str, splits: Sequence[str]) -> int:
    """Replace the given splits of a stored corpus by the rows of ``df``, all at once; gives the new version.

    Rows are written once, in a folder per split, and files of other splits are
    not touched.  A split without rows becomes empty; a row of another split, or
    of none, is an error and changes nothing.  Readers see the corpus before or
    after, never between.
    """
    spark = df.sparkSession
    version, state = current(spark, path)
    run = uuid.uuid4().hex
    df.write.partitionBy("split").parquet(f"{path}/{PARTS}/{run}")
    written = {name.removeprefix("split=") for name in folder_names(spark, f"{path}/{PARTS}/{run}") if name.startswith("split=")}
    if written - set(splits):
        remove_parts(spark, path, PARTS, set(folder_names(spark, f"{path}/{PARTS}")) - {run})
        raise ValueError(f"rows of {sorted(written - set(splits))}, but only {list(splits)} are rewritten")
    runs = state.get("splits", {}) | {split: run if split in written else None for split in splits}
    return publish(spark, path, version, {"splits": runs, "schema": df.drop("split").schema.json()})


def read_stored_splits(spark: SparkSession, path: str, splits: Sequence[str] | None = None) -> DataFrame:
    """Current rows of a corpus written by :func:`rewrite_splits`, with the columns of its last version."""
    runs = current(spark, path)[1]
    if not runs or set(splits or ()) - set(runs["splits"]):
        raise ValueError(f"{path} has only the splits {sorted(runs.get('splits', {}))}")
    schema = T.StructType.fromJson(json.loads(runs["schema"]))
    out = spark.createDataFrame([], schema).withColumn("split", F.lit(""))
    for split in runs["splits"] if splits is None else splits:
        if runs["splits"][split] is not None:
            part = spark.read.schema(schema).parquet(f"{path}/{PARTS}/{runs['splits'][split]}/split={split}")
            out = out.unionByName(part.withColumn("split", F.lit(split)))
    return out


def clean_splits(spark: SparkSession, path: str) -> list[str]:
    """Delete writes of which no split is current, at a time when nobody reads or writes the corpus."""
    return remove_parts(spark, path, PARTS, set(current(spark, path)[1].get("splits", {}).values()))


def write_predictions(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Prediction rows as JSON or CSV; CSV has no lists, so they become JSON."""
    if fmt == "csv":
        nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        df.withColumns({name: F.to_json(name) for name in nested}).write.mode("error").option("header", True).csv(path)
    else:
        df.write.mode("error").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metrics table; its size depends only on the label spaces."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_embeddings(fresh: DataFrame, path: str) -> None:
    """Append new cache rows (content_key, embedding)."""
    fresh.write.mode("append").parquet(path)
