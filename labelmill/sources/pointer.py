"""Which version of a stored table is the current one.

A table that is written anew in parts keeps every part in a folder of its own.
A small file names the folders that count, and the file with the highest number
is current.  It appears under its name at once or not at all, so readers see
the old parts or the new ones, never a mix; a job that dies before leaves only
folders that nothing names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: Spark does not list folders that begin with an underscore as part of a table.
FOLDER = "_versions"
DIGITS = 12


class ChangedMeanwhile(RuntimeError):
    """Another writer published the same version first."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it is missing."""
    files, path = _path(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []


def current(spark: SparkSession, table: str) -> tuple[int, dict]:
    """Number and content of the current version; ``(0, {})`` where none is published."""
    versions = [int(name) for name in folder_names(spark, f"{table}/{FOLDER}") if name.isdigit()]
    if not versions:
        return 0, {}
    files, path = _path(spark, f"{table}/{FOLDER}/{max(versions):0{DIGITS}d}")
    stream = files.open(path)
    try:
        return max(versions), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, table: str, after: int, content: dict) -> int:
    """Make ``content`` the version that follows ``after``.

    Raises :class:`ChangedMeanwhile` if that version is there already; nothing
    is changed then, and the caller may start again from the new version.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    files, draft = _path(spark, f"{table}/{FOLDER}/.draft-{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(content), "utf-8"))
    finally:
        stream.close()
    _, final = _path(spark, f"{table}/{FOLDER}/{after + 1:0{DIGITS}d}")
    # Without the overwrite option, a rename to a name that exists fails.
    no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(
            files.makeQualified(draft), files.makeQualified(final), no_options)
    except Exception as failed:
        files.delete(draft, False)
        if files.exists(final):
            raise ChangedMeanwhile(f"{table}: version {after + 1} is published already") from failed
        raise
    return after + 1


def remove_parts(spark: SparkSession, table: str, parts: str, keep: set[str]) -> list[str]:
    """Delete the folders below ``table/parts`` that ``keep`` does not name.

    Only for times without readers of older versions and without writers."""
    gone = sorted(name for name in folder_names(spark, f"{table}/{parts}" if parts else table) if name not in keep)
    for name in gone:
        files, path = _path(spark, "/".join(p for p in (table, parts, name) if p))
        files.delete(path, True)
    return gone
