import pytest
from pyspark.sql import functions as F

from labelmill import config as G
from labelmill.operators import profile as P

SPEC = G.AGRONOMY_SPEC_5
NO = (False,) * 5


def corpus(spark, rows):
    """Rows of (id, input, domain, flags, crops, topics, intent, difficulty)."""
    flags = ", ".join(f"{f} boolean" for f in SPEC.flags)
    schema = f"id int, input string, is_ag_related boolean, {flags}, crops array<string>, topics array<string>, intent string, difficulty string"
    return spark.createDataFrame([(i, t, d, *f, c, tp, n, x) for i, t, d, f, c, tp, n, x in rows], schema).repartition(3)


ROWS = [
    (1, "field looks bad", True, (True, False, True, False, False), ["corn"], ["soil", "weather"], "question", "hard"),
    (2, "what time is the movie tonight then", False, NO, [], [], "other", "simple"),
    (3, "is it off.", True, (False, False, True, False, False), ["corn"], ["weather"], "question", "hard"),
    (4, "Field, looks  bad!", True, (False, False, True, False, False), ["soybean"], ["weather"], "planning", "medium"),
]


def test_stats_of_small_corpus(spark):
    r = P.corpus_stats(corpus(spark, ROWS), "is_ag_related", "needs_rag", G.VAGUE_PHRASES).first()
    assert (r.total, r.domain_total, r.non_domain_total, r.short_rows, r.vague_rows, r.multi_topic_rows, r.hard_rows) == (4, 3, 1, 3, 2, 1, 2)
    assert r.non_domain_ratio == 0.25 and r.lead_flag_ratio == 1 / 3 and r.short_ratio == 0.75


def test_stats_of_nothing_have_zero_ratios(spark):
    r = P.corpus_stats(corpus(spark, []), "is_ag_related", "needs_rag", G.VAGUE_PHRASES).first()
    assert r.total == 0 and r.short_ratio == 0.0 and r.lead_flag_ratio == 0.0


def test_marks_give_the_same_stats_and_duplicates(spark):
    df = corpus(spark, ROWS)
    marks = P.text_marks(df, G.VAGUE_PHRASES)
    assert "input" not in marks.columns
    args = ("is_ag_related", "needs_rag", G.VAGUE_PHRASES)
    assert P.corpus_stats(marks, *args).collect() == P.corpus_stats(df, *args).collect()
    assert [(r.n, r.first) for r in P.duplicate_groups(marks).collect()] == [(2, 1)]
    assert P.duplicate_groups(df, position=["id", "intent"]).first().first == (1, "question")


def test_histograms_count_scalars_lists_and_flags(spark):
    got = {(r.field, r.value): r.n for r in P.histogram(corpus(spark, ROWS), ["intent"], ["crops"], ["needs_rag"]).collect()}
    assert got == {("intent", "question"): 2, ("intent", "other"): 1, ("intent", "planning"): 1, ("crops", "corn"): 2, ("crops", "soybean"): 1,
                   ("needs_rag", "true"): 1, ("needs_rag", "false"): 3}


def test_overview_keeps_positive_flags_only(spark):
    got = {(r.field, r.value): r.n for r in P.dataset_overview(corpus(spark, ROWS), SPEC).collect()}
    assert got[("needs_weather_data", "true")] == 3 and ("needs_rag", "false") not in got and got[("is_ag_related", "false")] == 1


def test_combos_with_minimums_count_missing_as_zero(spark):
    got = {r.combo: (r.n, r.min_n, r.ok) for r in P.combo_minimums(corpus(spark, ROWS), SPEC.flags, G.EDGE_COMBOS).collect()}
    assert got["weather_only"] == (2, 20, False) and got["rag_plus_weather"] == (1, 20, False)
    assert got["epa_only"] == (0, 0, True) and got["web_only"] == (0, 20, False) and len(got) == 8


def test_label_coverage_with_and_without_unseen_labels(spark):
    df = corpus(spark, ROWS)
    total = df.agg(F.count_if("is_ag_related").alias("domain_total"))
    full = {r.label: (r.n, r.min_n, r.low) for r in P.label_coverage(df, "topics", SPEC.topics, total, floor=2).collect()}
    assert full["weather"] == (3, 2, False) and full["soil"] == (1, 2, True) and full["pest"] == (0, 2, True) and len(full) == 12
    seen = P.label_coverage(df, "topics", SPEC.topics, total, floor=1, share=0.9, zero=False)
    assert {r.label: (r.n, r.min_n) for r in seen.collect()} == {"weather": (3, 2), "soil": (1, 2)}


def stats_row(spark, **values):
    base = {"non_domain_ratio": 0.3, "lead_flag_ratio": 0.5, "short_ratio": 0.1, "vague_ratio": 0.1, "multi_topic_ratio": 0.3, "hard_rows": 100, "domain_total": 100}
    base |= values
    return spark.createDataFrame([tuple(float(v) for v in base.values())], ", ".join(f"{k} double" for k in base))


@pytest.mark.parametrize("change,failed", [
    ({}, []), ({"non_domain_ratio": 0.25}, []), ({"non_domain_ratio": 0.2499}, ["non_domain_ratio"]), ({"non_domain_ratio": 0.36}, ["non_domain_ratio"]),
    ({"lead_flag_ratio": 0.71, "hard_rows": 99}, ["hard_rows", "lead_flag_ratio"]), ({"short_ratio": 0.07, "vague_ratio": 0.03}, ["short_ratio", "vague_ratio"]),
])
def test_gate_bands(spark, change, failed):
    checks = P.distribution_gate(stats_row(spark, **change), G.GATE_BANDS)
    assert sorted(r.check for r in checks.filter("severity = 'fail'").collect()) == failed
    if failed:
        with pytest.raises(ValueError, match=failed[0]):
            P.raise_on_fail(checks)
    else:
        P.raise_on_fail(checks)
    soft = P.distribution_gate(stats_row(spark, **change), G.REPORT_BANDS, severity="warn")
    P.raise_on_fail(soft)
    assert {r.check for r in soft.collect()} == {b.check for b in G.REPORT_BANDS}


def audit(spark, stats, combos, topics, duplicates):
    return sorted((r.kind, r.subject) for r in P.audit_findings(
        stats, G.AUDIT_BANDS, spark.createDataFrame(combos, "combo string, n bigint"), spark.createDataFrame(topics, "value string, n bigint"),
        spark.createDataFrame([(duplicates,)], "duplicate_groups bigint")).collect())


def test_audit_findings(spark):
    bad = stats_row(spark, non_domain_ratio=0.4, lead_flag_ratio=0.61, vague_ratio=0.07)
    got = audit(spark, bad, [("a", 0), ("b", 11), ("c", 12)], [("x", 7), ("y", 23), ("z", 8)], 2)
    assert got == [("diluting", "non_domain_ratio"), ("duplicate_inputs", "input"), ("frequent_topic", "y"), ("missing_combo", "a"),
                   ("overrepresented", "lead_flag_ratio"), ("rare_topic", "x"), ("sparse_combo", "b"), ("underrepresented", "vague_ratio")]


def test_clean_audit_says_so(spark):
    assert audit(spark, stats_row(spark), [("a", 12)], [("x", 10)], 0) == [("none", "none")]


def test_audit_diff(spark):
    stats = spark.createDataFrame([("old", 4, 1), ("new", 10, 3)], "snap string, total bigint, short_rows bigint")
    got = {r.metric: (r.before, r.after, r.delta) for r in P.audit_diff(stats, "snap", "old", "new", ["total", "short_rows"]).collect()}
    assert got == {"total": (4.0, 10.0, 6.0), "short_rows": (1.0, 3.0, 2.0)}


def test_samples_take_first_rows_per_class(spark):
    classes = {"outside": ~F.col("is_ag_related"), "weather": F.col("needs_weather_data"), "never": F.lit(False)}
    picks = P.class_samples(corpus(spark, ROWS), classes, [F.col("id")], 2)
    assert sorted((r["class"], r.pick, r.id) for r in picks.collect()) == [("outside", 1, 2), ("weather", 1, 1), ("weather", 2, 3)]


def test_modules_and_splits(spark):
    got = {r.module: r.n for r in P.module_activation(corpus(spark, ROWS), G.FLAG_MODULES).collect()}
    assert got == {"rag": 1, "weather_api": 3, "none": 1}
    df = spark.createDataFrame([("train",), ("train",), ("extra",)], "split string")
    got = {r.split: (r.expected, r.actual, r.ok) for r in P.split_expectation(df, [("train", 2), ("val", 1)]).collect()}
    assert got == {"train": (2, 2, True), "val": (1, 0, False), "extra": (0, 1, False)}
