"""Lexicons kept as tables against a search for every keyword."""

import random

from pyspark.sql import functions as F

from labelmill.config import AGRONOMY
from labelmill.functions import text as X
from labelmill.operators import lexicon as L
from labelmill.operators.scale import dim


def found(spark, texts, keywords):
    frame = dim(spark, texts, "id long, input string")
    rows = L.keyword_hits(frame, dim(spark, keywords, "label string, keyword string"), "id")
    assert rows.columns == ["id", "label", "keyword"]
    return sorted(tuple(r) for r in rows.collect())


def expected(texts, keywords):
    return sorted((i, label, word) for i, text in texts for label, word in keywords if word and word in (text or "").lower())


def test_a_hundred_thousand_keywords(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    texts = [(i, word(300)) for i in range(30)]
    cut = [(f"own{i}", t[at:at + n]) for i, t in texts for at, n in ((0, 9), (120, 25), (291, 9), (0, 300))]
    keywords = [(f"l{i % 7}", word(rng.randint(2, 9))) for i in range(100_000)] + cut
    hits = found(spark, texts, keywords)
    assert hits == expected(texts, keywords) and len(hits) > 10_000


def test_special_texts_and_keywords(spark):
    texts = [(1, None), (2, ""), (3, "Corn CORN corn"), (4, "a.b*c \U0001f33d\U0001f33d maize\U0001f33d"), (5, "x" * 200_000 + "needle in here")]
    keywords = [("a", "corn"), ("b", "corn"), ("a", "corn"), ("c", ""), ("c", None), ("d", ".b*"), ("d", "b.c"), ("e", "\U0001f33d"), ("e", "maize\U0001f33d"), ("f", "needle in here"), ("f", "xxxxxxx")]
    assert found(spark, texts, keywords) == expected(texts, keywords)
    assert found(spark, [], keywords) == [] and found(spark, texts, [("a", ""), ("b", None)]) == []


def test_the_preset_gives_the_same_rows_both_ways(spark):
    lexicon = AGRONOMY.topic_keywords
    texts = [(i, " and ".join(words[:2])) for i, words in enumerate(lexicon.values())] + [(99, "nothing of it")]
    frame = dim(spark, texts, "id long, input string")
    by_column = frame.select("id", *[c.alias(n) for n, c in L.match_columns(X.lowered(F.col("input")), lexicon, "").items()])
    one_way = {(r["id"], label) for r in by_column.collect() for label in lexicon if r[label]}
    rows = [(label, word) for _, label, _, word in L.lexicon_rows(lexicon, "topics")]
    assert {(i, label) for i, label, _ in found(spark, texts, rows)} == one_way


def test_no_text_meets_all_keywords(spark):
    frame = spark.range(10).select("id", F.lit("some text").alias("input"))
    plan = L.keyword_hits(frame, dim(spark, [("a", "some t")], "label string, keyword string"), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_texts_meet_a_keyword_in_vain(spark):
    """All short grams are common here, which made every text meet every keyword."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    texts = [(i, word(500)) for i in range(40)] + [(40, "é" * 30 + word(30))]
    keywords = [("x", k) for k in sorted({word(n) for n in (12, 24, 30) for _ in range(200)} | {"é" * 7 + "é"})]
    frame, words = dim(spark, texts, "id long, input string"), dim(spark, keywords, "label string, keyword string")
    assert found(spark, texts, keywords) == expected(texts, keywords)
    short = [(label, k) for label, k in keywords if len(k) in (12, 24)]
    met = L.keyword_pairs(frame, dim(spark, short, "label string, keyword string"), "id").count()
    assert met == len(expected(texts, short)) < len(texts) * len(short) / 4
    assert L.keyword_pairs(frame, words, "id").count() < len(texts) * len(keywords) / 3


def test_grams_that_cross_windows(spark, monkeypatch):
    import pyarrow as pa

    texts = ["abcdefghijkl" * 5, "", "xabcdefghijklx", "abcdefghijk"]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array(texts)], names=["id", "text"])
    rows = {}
    for window in (1, 7, 13, 1 << 20):
        monkeypatch.setattr(L, "WINDOW", window)
        rows[window] = sorted(tuple(r.values()) for b in L._gram_rows([3, 6, 12])([batch]) for r in b.to_pylist())
    assert rows[1] == rows[7] == rows[13] == rows[1 << 20]
    assert len(rows[1]) == len({(i, t[k:k + n]) for i, t in zip((5, 6, 7, 8), texts) for n in (3, 6, 12) for k in range(len(t) - n + 1)})
