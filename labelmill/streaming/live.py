"""Streaming versions of routing and of the log fold."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelmill.config import LabelSpec, RuleConfig
from labelmill.operators.corpus import log_schema
from labelmill.operators.feedback import fold_parts, interactions
from labelmill.operators.logodds import Scorer, TokenModel
from labelmill.operators.route import route, split_blank, to_events
from labelmill.operators.validate import split_lines
from labelmill.sources.files import parse_events
from labelmill.sources.pointer import FOLDER, current, publish, remove_parts

#: Compacted interactions, beside the folders of batches.
BASES = "_bases"


def read_log_stream(spark: SparkSession, path: str, spec: LabelSpec) -> DataFrame:
    """Events of a log; a malformed one fails the query (see :func:`quarantine_log` for logs that may have some)."""
    return spark.readStream.schema(log_schema(spec)).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(path)


def quarantine_log(spark: SparkSession, path: str, spec: LabelSpec, events: str, rejected: str, checkpoint: str,
                   available_now: bool = True) -> StreamingQuery:
    """Split a log that may have bad lines into tables of events and of rejected lines (file, value, reason).

    Both are written per batch under ``batch=<id>``; a replayed batch overwrites
    its own folders, so each line is in one of them exactly once, also after a
    failure between the two writes.
    """
    lines = spark.readStream.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_name").alias("file"), "value")

    def write(batch: DataFrame, batch_id: int) -> None:
        readable, unreadable = split_lines(batch)
        good, strange = parse_events(readable, spec)
        good.write.mode("overwrite").parquet(f"{events}/batch={batch_id}")
        unreadable.unionByName(strange).write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def route_stream(queries: DataFrame, scorer: Scorer, cfg: RuleConfig, text: str = "input") -> DataFrame:
    """Routed stream.  Routing is a narrow projection, so it runs in append
    mode without state.  Blank texts cannot be routed; :func:`rejected_stream`
    has them."""
    texts, _ = split_blank(queries, text)
    return route(texts, scorer, cfg, text)


def rejected_stream(queries: DataFrame, text: str = "input") -> DataFrame:
    """The rows of the stream that have no text."""
    return split_blank(queries, text)[1]


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Exactly-once file sink."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fold_stream(events: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write changed interactions of each batch under ``batch=<id>``.

    A replayed batch overwrites its own folder, so the table stays correct.
    State is one row per interaction.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = fold_parts(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _newest(versions: DataFrame) -> DataFrame:
    """The last version of each interaction, with its batch."""
    rest = [c for c in versions.columns if c != "interaction"]
    return versions.groupBy("interaction").agg(F.max_by(F.struct(*rest), "batch").alias("row")).select("interaction", "row.*")


def _versions(spark: SparkSession, path: str, state: dict, through: int | None = None) -> DataFrame:
    """Newest version of each interaction up to a batch: the base, and what batches after it replace or add."""
    batches = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
    if through is not None:
        batches = batches.filter(F.col("batch") <= through)
    if not state:
        return _newest(batches)
    later = _newest(batches.filter(F.col("batch") > state["through"]))
    base = spark.read.parquet(f"{path}/{BASES}/{state['base']}")
    # Later batches are few beside the base, which is then neither sorted nor shuffled.
    return base.join(later.select("interaction"), "interaction", "left_anti").unionByName(later.select(*base.columns))


def read_fold(spark: SparkSession, path: str) -> DataFrame:
    """Current interactions: the newest version of each, folded as in batch.

    After :func:`compact_fold` only the base and the batches after it are read.
    """
    return interactions(_versions(spark, path, current(spark, path)[1]).drop("batch"))


def compact_fold(spark: SparkSession, path: str) -> int | None:
    """Merge the base and all finished batches into a new base; gives the last batch in it, None if there is nothing new.

    The newest batch stays out, as a stream may write it again after a failure;
    all before it are final, so the stream may go on meanwhile.  The new base
    counts once its pointer is published; a job that dies before that leaves the
    rows as they were, and so does one that another compaction outruns.
    """
    version, state = current(spark, path)
    newest = spark.read.parquet(path).agg(F.max(F.col("batch").cast("long")).alias("batch")).first().batch
    done = None if newest is None else newest - 1
    if done is None or done < 0 or (state and done <= state["through"]):
        return None
    name = uuid.uuid4().hex
    _versions(spark, path, state, done).write.parquet(f"{path}/{BASES}/{name}")
    publish(spark, path, version, {"base": name, "through": done})
    return done


def clean_fold(spark: SparkSession, path: str) -> list[str]:
    """Delete bases and batches that the current base replaces, at a time when nobody reads or compacts the fold."""
    _, state = current(spark, path)
    if not state:
        return []
    batches = [r.batch for r in spark.read.parquet(path).select(F.col("batch").cast("long")).distinct().collect()]
    keep = {f"batch={b}" for b in batches if b > state["through"]} | {BASES, FOLDER}
    return remove_parts(spark, path, BASES, {state["base"]}) + remove_parts(spark, path, "", keep)


def route_and_log(queries: DataFrame, model: TokenModel | Scorer, cfg: RuleConfig, path: str, checkpoint: str,
                  text: str = "input", name: str = "routed", available_now: bool = True, rejected: str | None = None) -> StreamingQuery:
    """Score each query and append its inference event to the log; rows without
    text go to the folder ``rejected``, where one is given.

    The event id is derived from the query's ``id``, and each batch has its own
    folder below the log, so a replayed batch gives the same events once.  (A
    streaming file sink would hide files that batch jobs append to the log.)
    """
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00") if "timestamp" in queries.columns else None

    def write(batch: DataFrame, batch_id: int) -> None:
        texts, blank = split_blank(batch, text)
        events = to_events(route(texts, model, cfg, text), cfg, text, event_id=F.md5(F.col("id").cast("string")), at=at)
        events.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}-{batch_id:09d}")
        if rejected is not None:
            blank.write.mode("overwrite").json(f"{rejected}/{name}-{batch_id:09d}")

    writer = queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
