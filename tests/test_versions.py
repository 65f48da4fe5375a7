"""Stored tables that change in parts: the compacted fold and corpora whose splits are rewritten."""

import os

import pytest
from pyspark.sql import functions as F

from labelmill.operators import feedback as FB
from labelmill.sources import files, pointer
from labelmill.streaming import live
from test_feedback import EVENTS, SPEC, write_log


def folded(spark, path):
    return live.read_fold(spark, path).orderBy("interaction_id").collect()


@pytest.fixture()
def fold(spark, tmp_path):
    """A stream folded in two batches, and what a batch fold of the same events gives."""
    folder, out = tmp_path / "log", str(tmp_path / "out")

    def more(events, name):
        write_log(folder, events, name)
        live.fold_stream(live.read_log_stream(spark, str(folder), SPEC), out, str(tmp_path / "ck")).awaitTermination()

    half = (len(EVENTS) - 4) // 2
    more(EVENTS[:half], "first.jsonl")
    more(EVENTS[half:-4], "second.jsonl")
    expected = lambda: FB.fold(files.read_log(spark, str(folder), SPEC)).orderBy("interaction_id").collect()
    return out, more, expected


def test_compaction_keeps_rows_and_reads_only_base_and_later_batches(spark, fold):
    out, more, expected = fold
    before = folded(spark, out)
    assert before == expected()
    done = live.compact_fold(spark, out)
    last = max(int(n.removeprefix("batch=")) for n in os.listdir(out) if n.startswith("batch="))
    assert done == last - 1 and folded(spark, out) == before
    plan = live.read_fold(spark, out)._jdf.queryExecution().sparkPlan().toString()
    filters = [line.split("PartitionFilters: ")[1].split("], ")[0] for line in plan.splitlines() if "FileScan" in line]
    assert filters.count("[") == 1 and all(f == "[" or f"> {done})" in f for f in filters)
    # The base is neither sorted nor shuffled for the batches after it.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert live.compact_fold(spark, out) is None
    more(EVENTS[-4:], "rest.jsonl")
    assert folded(spark, out) == expected()
    live.compact_fold(spark, out)
    gone = live.clean_fold(spark, out)
    assert f"batch={done}" in gone and sum(1 for n in os.listdir(f"{out}/{live.BASES}")) == 1
    assert folded(spark, out) == expected()


def test_a_compaction_that_dies_changes_nothing(spark, fold, monkeypatch):
    out, _, expected = fold

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(live, "publish", dies)
    with pytest.raises(RuntimeError, match="lost"):
        live.compact_fold(spark, out)
    assert pointer.current(spark, out) == (0, {}) and folded(spark, out) == expected()
    monkeypatch.undo()
    live.compact_fold(spark, out)
    assert folded(spark, out) == expected() and len(os.listdir(f"{out}/{live.BASES}")) == 2
    live.clean_fold(spark, out)
    assert folded(spark, out) == expected() and len(os.listdir(f"{out}/{live.BASES}")) == 1


def test_versions_are_published_once(spark, tmp_path):
    table = str(tmp_path / "t")
    assert pointer.current(spark, table) == (0, {})
    assert pointer.publish(spark, table, 0, {"a": "é"}) == 1
    with pytest.raises(pointer.ChangedMeanwhile):
        pointer.publish(spark, table, 0, {"a": 2})
    assert pointer.current(spark, table) == (1, {"a": "é"})
    assert not [n for n in os.listdir(f"{table}/{pointer.FOLDER}") if n.startswith(".draft")]


def _files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{path}/{files.PARTS}") for n in names}


def test_rewriting_a_split_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = spark.range(30).select("id", F.concat(F.lit("t"), "id").alias("input"), F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    assert files.rewrite_splits(rows, path, ["train", "val", "test"]) == 1
    old, held = files.read_stored_splits(spark, path), _files(path)
    changed = rows.filter("split = 'train'").withColumn("input", F.upper("input"))
    assert files.rewrite_splits(changed, path, ["train"]) == 2
    # A reader that began before still has its version whole, and no file of it was touched.
    assert sorted(old.collect()) == sorted(rows.collect())
    assert held.items() <= _files(path).items()
    now = {r.id: r for r in files.read_stored_splits(spark, path).collect()}
    assert len(now) == 30 and all(r.input == (f"T{r.id}" if r.split == "train" else f"t{r.id}") for r in now.values())
    assert {r.split for r in files.read_stored_splits(spark, path, ["val"]).collect()} == {"val"}


def test_rows_of_other_splits_and_empty_splits(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = spark.createDataFrame([(1, "train"), (2, "val")], "id long, split string")
    files.rewrite_splits(rows, path, ["train", "val"])
    for strange in (rows, spark.createDataFrame([(3, None)], "id long, split string")):
        with pytest.raises(ValueError, match="only"):
            files.rewrite_splits(strange, path, ["train"])
    assert pointer.current(spark, path)[0] == 1 and len(os.listdir(f"{path}/{files.PARTS}")) == 1
    files.rewrite_splits(rows.limit(0), path, ["train"])
    assert [tuple(r) for r in files.read_stored_splits(spark, path).select("id", "split").collect()] == [(2, "val")]
    files.rewrite_splits(rows.limit(0), path, ["val"])
    assert files.read_stored_splits(spark, path).count() == 0 and len(files.clean_splits(spark, path)) >= 1
    with pytest.raises(ValueError, match="splits"):
        files.read_stored_splits(spark, path, ["test"])
