"""The bucketed cache of embeddings."""

import glob

import pytest
from pyspark.sql import functions as F

from labelmill.sources import pointer
from labelmill.sources import vector_cache as VC


def shape(text):
    return F.array(F.length(text).cast("double"), F.lit(0.5))


def rows_of(df):
    return sorted((r.id, tuple(r.embedding), r.was_cached) for r in df.collect())


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None), (5, "")], "id int, input string")


def test_a_text_is_encoded_once(spark, texts, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encoder(text):
        calls.add(1)
        return [float(len(text)), 0.5]

    cache = VC.open_cache(spark, str(tmp_path), "lengths", 4)
    first = VC.embed_cached(texts, cache, encoder)
    assert rows_of(first) == [(1, (2.0, 0.5), False), (2, (1.0, 0.5), False), (3, (2.0, 0.5), False), (4, (0.0, 0.5), False), (5, (0.0, 0.5), False)]
    assert first.columns == ["id", "input", "embedding", "was_cached"] and calls.value == 3
    more = texts.unionByName(spark.createDataFrame([(6, "ccc")], texts.schema))
    again = rows_of(VC.embed_cached(more, VC.open_cache(spark, str(tmp_path), "lengths"), encoder))
    assert [r[2] for r in again] == [True] * 5 + [False] and again[-1][1] == (3.0, 0.5) and calls.value == 4


def test_the_cache_is_not_shuffled(spark, texts, tmp_path):
    cache = VC.open_cache(spark, str(tmp_path), "lengths", 16)
    VC.embed_cached(texts, cache, shape)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = texts.groupBy(F.md5("input").alias(VC.KEY)).count().repartition(cache.buckets, VC.KEY)
        met = wanted.join(VC.vectors(spark, cache), VC.KEY, "left")
        met.collect()
        plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # One exchange counts the texts, one deals them to the buckets; the cache side has none.
        assert "SelectedBucketsCount: 16 out of 16" in plan and plan.count("Exchange hashpartitioning") == 2 and "Broadcast" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compaction_keeps_the_rows_in_one_file_per_bucket(spark, texts, tmp_path):
    cache = VC.open_cache(spark, str(tmp_path), "lengths", 2)
    for n in range(4):
        VC.embed_cached(spark.createDataFrame([(n, f"text {n % 3}{'x' * n}")], texts.schema), cache, shape)
    # A run that did not see the others' rows adds one of them again.
    VC.add(spark.table(cache.table).limit(1), cache)
    before = sorted(map(tuple, VC.vectors(spark, cache).collect()))
    assert spark.table(cache.table).count() == 5 and len(before) == 4
    for buckets in (2, 3):
        new = VC.compact(spark, str(tmp_path), buckets)
        assert sorted(map(tuple, spark.table(new.table).collect())) == before
        folder = pointer.current(spark, str(tmp_path))[1]["folder"]
        assert 1 <= len(glob.glob(f"{tmp_path}/{VC.PARTS}/{folder}/part-*")) <= buckets
    opened = VC.open_cache(spark, str(tmp_path), "lengths")
    assert opened == new and opened.buckets == 3
    assert all(r.was_cached for r in VC.embed_cached(spark.createDataFrame([(9, "text 0")], texts.schema), opened, shape).collect())
    assert len(VC.clean(spark, str(tmp_path))) == 2 and len(VC.vectors(spark, opened).collect()) == 4


def test_a_compaction_that_dies_or_loses_changes_nothing(spark, texts, tmp_path, monkeypatch):
    cache = VC.open_cache(spark, str(tmp_path), "lengths", 2)
    VC.embed_cached(texts, cache, shape)
    monkeypatch.setattr(VC, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("dies")))
    with pytest.raises(RuntimeError, match="dies"):
        VC.compact(spark, str(tmp_path))
    monkeypatch.undo()
    assert VC.open_cache(spark, str(tmp_path), "lengths") == cache and VC.vectors(spark, cache).count() == 3


def test_null_vectors_are_tried_again_and_other_encoders_refused(spark, texts, tmp_path):
    cache = VC.open_cache(spark, str(tmp_path), "lengths", 2)
    out = VC.embed_cached(texts, cache, lambda t: F.when(t != "b", shape(t)))
    assert [r.id for r in out.filter("embedding IS NULL").collect()] == [2]
    again = VC.embed_cached(texts.withColumn("embedding", F.lit("own")), cache, shape)
    assert [r[2] for r in rows_of(again)] == [True, False, True, True, True]
    assert VC.embed_cached(texts.limit(0), cache, shape).count() == 0
    with pytest.raises(ValueError, match="not of 'other'"):
        VC.open_cache(spark, str(tmp_path), "other")
    with pytest.raises(ValueError, match="no cache"):
        VC.compact(spark, str(tmp_path / "nothing"))
