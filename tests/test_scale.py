import random

import pytest
from pyspark.sql import functions as F

from labelmill.operators import scale as Z


def test_global_rank_is_the_sorted_position(spark):
    values = list(range(500))
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([(v // 7, v) for v in values], "a int, b int").repartition(5)
    ranked = Z.global_rank(df, [F.desc("a"), F.col("b")], partitions=6)
    rows = sorted(((r["rank"], r["a"], r["b"]) for r in ranked.collect()))
    assert [(a, b) for _, a, b in rows] == sorted(((v // 7, v) for v in values), key=lambda x: (-x[0], x[1]))
    assert [r for r, _, _ in rows] == list(range(1, 501))


def test_global_rank_of_nothing(spark):
    assert Z.global_rank(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


@pytest.mark.parametrize("hot_rows", [1_000_000, 10, 0])
def test_join_by_key_gives_the_same_rows_for_hot_and_cold_keys(spark, hot_rows):
    df = spark.createDataFrame([("hot", i) for i in range(50)] + [(f"k{i % 7}", i) for i in range(20)], "k string, v int")
    stats = df.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low")).filter("n > 1")
    got = Z.join_by_key(df, stats, "k", "n", hot_rows)
    want = df.join(stats, "k").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_explode_rows_drops_empty_arrays_without_a_pushed_filter(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "id int, t string").withColumn("xs", F.filter(F.split("t", " "), lambda x: x != ""))
    out = Z.explode_rows(df, ["id"], "xs", "x")
    assert [tuple(r) for r in out.collect()] == [(1, "a"), (1, "b")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(4)
    out = Z.top_k(df, ["k"], [F.desc("v")], 2, "place")
    assert sorted((r.k, r.place, r.v) for r in out.collect()) == [(0, 1, 99), (0, 2, 96), (1, 1, 97), (1, 2, 94), (2, 1, 98), (2, 2, 95)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_dim_is_a_local_relation_with_known_size(spark):
    table = Z.dim(spark, [("a", True, 1), ("b", None, 2)], "x string, y boolean, z bigint")
    assert [tuple(r) for r in table.collect()] == [("a", True, 1), ("b", None, 2)]
    assert "LocalRelation" in table._jdf.queryExecution().optimizedPlan().toString()
    assert Z.dim(spark, [], "x string").count() == 0


def test_intermediate_tables_go_to_the_configured_folder(spark):
    folder = Z.shared_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert folder == (configured or folder)
    out = Z.cut_lineage(spark.range(3).select("id", F.array(F.col("id")).alias("a")))
    assert sorted(map(tuple, out.collect())) == [(0, [0]), (1, [1]), (2, [2])]
    assert all(folder in path for path in out.inputFiles())
    assert Z.cut_lineage(spark.range(0)).count() == 0


def test_first_n_by_merge_and_by_rank(spark, monkeypatch):
    df = spark.range(200).select((F.col("id") * 7 % 200).alias("v"))
    few = sorted(r.v for r in Z.first_n(df, [F.desc("v")], 30).collect())
    monkeypatch.setattr(Z, "MERGE_ROWS", 5)
    assert few == sorted(r.v for r in Z.first_n(df, [F.desc("v")], 30).collect()) == list(range(170, 200))
