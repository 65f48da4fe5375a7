import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.llm import quality

SF = "/root/testdata/sf0.01"


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["water", "tree", "house", "river", "stone", "light", "walks", "under", "green"]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(3, 60)))
    kinds = [lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: " ".join(w + "$$$" for w in good().split()), lambda: " ".join([rng.choice(words)] * 40)]
    return [(i, good(), 1) if rng.random() < 0.7 else (i, rng.choice(kinds)(), 0) for i in range(n)]


def test_held_out_rows_by_checksum(spark):
    got = spark.range(500).select("id", quality.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_learns_from_the_other_rows_only(spark):
    rows = texts(900)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(3, None, 0), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    held = [(got[i].predicted, q) for i, _, q in rows if got[i].held_out]
    assert len(held) > 150 and sum(p == q for p, q in held) / len(held) > 0.97
    wrong = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.scored(docs, wrong).collect()}
    assert again == {i: r.score for i, r in got.items()}, "labels of held-out rows must not matter"
    sample = quality.training_sample(docs, labels, per_class=20).collect()
    assert sorted(r.quality for r in sample) == [0] * 20 + [1] * 20


def test_score_is_softmax_of_the_average(spark):
    model = quality.train([t for _, t, _ in texts(120)], [q for _, _, q in texts(120)])
    text = "water Tree tree tree !! river\n"
    parts = [model.parts[rows_of(w)].mean() for w in text.split()]
    odds = model.bias + np.mean([*parts, model.parts[quality.SAME]])
    got = spark.createDataFrame([(text,)], "text string").select(quality.score(model)("text")).first()[0]
    assert got == pytest.approx(1 / (1 + np.exp(-odds)))


def rows_of(word):
    rows, ends = quality.buckets_of([word])
    assert ends.tolist() == [len(rows)]
    return rows


def test_rows_of_a_word_do_not_depend_on_its_neighbours():
    words = ["tree", "é", "日本語の", "", "tree's", "x" * 50, "trees", "😀a"]
    rows, ends = quality.buckets_of(words)
    assert [r.tolist() for r in np.split(rows, ends[:-1])] == [rows_of(w).tolist() for w in words]
    assert [len(rows_of(w)) for w in words[:3]] == [1 + 4 + 3 + 2, 1 + 1, 1 + 4 + 3 + 2]
    # "<tre" is a gram of three of the words, "<tree" as well; the words differ in their own row.
    assert len(set(rows_of("tree").tolist()) & set(rows_of("trees").tolist())) == 6 and rows_of("tree")[0] != rows_of("trees")[0]
    assert quality.buckets_of([])[0].tolist() == []


def test_weights_of_documents():
    (some, empty, spaces) = quality._features(["a b b\tb", "", " \n "])
    assert some[1].sum() == pytest.approx(1) and dict(zip(*some))[quality.SAME] == pytest.approx(2 / 6)
    assert len(empty[0]) == len(spaces[0]) == 0


def test_a_repeated_id_gives_one_text(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(-50, 5)] + [(1, 1)], "doc_id long, quality int")
    got = quality.training_sample(docs, labels, per_class=20).collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(5) if zlib.crc32(str(i).encode()) % 4 != 2]


def test_nasty_and_unlabelled(spark, nasty, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.scored(nasty, none).collect()
    assert len(got) == nasty.count() and all(r.score == 0.5 and r.predicted == 0 for r in got)
    labels = spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 0, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.scored(nasty, labels).collect())
    assert quality.accepted(nasty, labels, threshold=0.0).columns == nasty.columns
    assert quality.scored(nothing, labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_accuracy_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs.select("doc_id", "text"), labels).join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
