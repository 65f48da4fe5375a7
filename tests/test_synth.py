import random

import pytest
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators import synth as M


def test_grid_is_in_nested_loop_order(spark):
    base = spark.createDataFrame([(2, "soy"), (1, "corn")], "id int, crop string")
    grid = M.template_grid(base, "c", ("{crop} {when}?", "dry {when}?"), {"crop": F.col("crop")}, {"when": ("now", "later")}, ["id"])
    assert [(r.candidate, r.template_pos) for r in grid.orderBy("order_key").collect()] == [
        ("corn now?", 0), ("dry now?", 1), ("corn later?", 0), ("dry later?", 1), ("soy now?", 0), ("dry now?", 1), ("soy later?", 0), ("dry later?", 1)]
    assert set(grid.columns) == {"id", "crop", "template_pos", "category", "candidate", "order_key"}
    assert "Join" not in grid._jdf.queryExecution().optimizedPlan().toString()


def test_a_grid_is_dealt_out_where_one_task_reads_its_base(spark):
    base = spark.range(0, 4000, 1, 1).select(F.when(F.col("id") % 4 > 0, F.col("id")).alias("id"), F.concat(F.lit("crop "), F.col("id")).alias("crop"))
    grid = M.template_grid(base, "c", ("{crop} {when}?", "dry {when}?"), {"crop": F.col("crop")}, {"when": ("now", "later")}, ["id"])
    sizes = [r.n for r in grid.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 16_000 and max(sizes) < 4_000


def test_cyclic_labels(spark):
    df = spark.range(6).withColumns(M.cyclic_labels(F.col("id"), ("q", "p"), ("low", "mid", "high")))
    assert [(r.intent, r.urgency, r.difficulty) for r in df.orderBy("id").collect()] == [
        ("q", "low", "hard"), ("p", "mid", "medium"), ("q", "high", "simple"), ("p", "low", "medium"), ("q", "mid", "hard"), ("p", "high", "medium")]
    hard = spark.range(3).withColumns(M.cyclic_labels(F.col("id"), ("q",), ("low",), F.col("id") == 2))
    assert [r.difficulty for r in hard.orderBy("id").collect()] == ["hard", "medium", "hard"]


def listed(spark, texts):
    rows = [(t, [i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "candidate string, order_key array<bigint>").repartition(3)


def test_unique_candidates_keep_the_first_and_drop_blank_and_known(spark):
    known = spark.createDataFrame([("Old  text!",), ("old text",)], "input string")
    fresh = M.unique_candidates(listed(spark, ["A b", "a  B!", "!!", "old text?", "old TEXT", "c"]), known)
    assert [r.candidate for r in fresh.orderBy("order_key").collect()] == ["A b", "old text?", "c"]
    assert M.unique_candidates(listed(spark, ["x", "X"]), None).count() == 1


def test_recycled_candidates_come_last_with_suffix(spark):
    again = M.recycled(listed(spark, ["who??", "go"]))
    assert [r.candidate for r in again.orderBy("order_key").collect()] == ["who??", "go", "who, please.", "go, please."]


def norm(text):
    import re
    return re.sub(r"[^a-z0-9? ]", "", re.sub(r"\s+", " ", text.strip().lower()))


def brute_quotas(categories, known):
    used, out = {norm(t) for t in known}, []
    for name, texts, quota in categories:
        taken = 0
        for text in texts:
            if taken < quota and norm(text) and norm(text) not in used:
                used.add(norm(text))
                out.append((name, text))
                taken += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotas_match_the_sequential_builder(spark, seed):
    rng = random.Random(seed)
    pool = [f"Text {i}" for i in range(12)]
    categories = [(name, [rng.choice(pool) + rng.choice(["", "!", " "]) for _ in range(15)], quota) for name, quota in (("a", 3), ("b", 6), ("c", 5))]
    known = ["text 3", "TEXT 4"]
    got = M.fill_quotas([(listed(spark, texts), name, quota) for name, texts, quota in categories], spark.createDataFrame([(k,) for k in known], "input string"))
    rows = [(r.category, r.candidate) for r in got.orderBy("category_pos", "order_key").collect()]
    assert rows == brute_quotas(categories, known)


def test_text_beyond_a_full_quota_stays_available(spark):
    got = M.fill_quotas([(listed(spark, ["x", "y"]), "a", 1), (listed(spark, ["x", "y"]), "b", 2)], None)
    assert sorted((r.category, r.candidate) for r in got.collect()) == [("a", "x"), ("b", "y")]
    short = {r.category: r.missing for r in M.quota_shortfall(got, [("a", 1), ("b", 2), ("z", 4)]).collect()}
    assert short == {"a": 0, "b": 1, "z": 4}
    with pytest.raises(ValueError, match="b lacks 1"):
        M.ensure_quotas(got, [("a", 1), ("b", 2)])


def test_jobs_of_quotas_do_not_grow_with_categories(spark):
    jobs = {}
    for n in (2, 12):
        spark.sparkContext.setJobGroup(f"quotas {n}", "count jobs")
        texts = [spark.range(3).select(F.concat(F.lit("t"), F.col("id") + k).alias("candidate"), F.col("id").alias("order_key")) for k in range(n)]
        got = M.fill_quotas([(candidates, f"c{k}", 2) for k, candidates in enumerate(texts)], None).collect()
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"quotas {n}"))
        # t0 t1 | t2 t3 | t4 | t5 | ... : every later category finds one new text, and the last ones left
        assert [sum(r.category_pos == k for r in got) for k in range(n)][:2] == [2, 2] and len({r.norm_key for r in got}) == len(got)
    assert jobs[12] <= jobs[2] + 2


def test_the_corpus_is_not_shuffled_for_few_candidates(spark):
    corpus = spark.range(1000).select(F.concat(F.lit("text "), F.col("id")).alias("input"))
    plan = M.unique_candidates(listed(spark, ["text 5", "new"]), corpus)._jdf.queryExecution().executedPlan().toString()
    assert [r.candidate for r in M.unique_candidates(listed(spark, ["text 5", "new"]), corpus).collect()] == ["new"]
    assert "LeftSemi" in plan and "SortMergeJoin" not in plan


def test_ids_and_splits_follow_acceptance_order(spark):
    accepted = M.fill_quotas([(listed(spark, ["c", "b"]), "k", 2), (listed(spark, ["a", "d"]), "l", 2)], None)
    existing = spark.createDataFrame([("route_000007", "x"), ("route_000041", "y")], "id string, input string")
    ids = M.assign_ids(accepted, existing, [F.col("category_pos"), F.col("order_key")])
    rows = M.allocate_splits(ids, [("train", 2), ("val", 1)]).orderBy("id").collect()
    assert [(r.id, r.candidate, r.split) for r in rows] == [
        ("route_000042", "c", "train"), ("route_000043", "b", "train"), ("route_000044", "a", "val"), ("route_000045", "d", None)]


def test_stratified_split_covers_every_stratum(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).cast("string").alias("s"))
    out = M.allocate_stratified(df, ["s"], "id", [("train", 0.8), ("test", 0.2)])
    shares = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert len(shares) == 6 and all(150 < n < 250 for (_, split), n in shares.items() if split == "test")


def test_ranked_rewrite_aligns_picks_and_phrases(spark):
    docs = spark.createDataFrame([(i, f"tmpl {i}" if i % 2 else f"keep {i}", "n") for i in range(8)], "id int, input string, notes string").repartition(3)
    picks = M.pick_rows(docs, F.col("input").startswith("tmpl"), "id", ["id"], 3)
    assert sorted((r.pick, r.id) for r in picks.collect()) == [(0, 1), (1, 3), (2, 5)]
    phrases = spark.createDataFrame([(1, "Keep 2"), (2, "fresh one"), (3, "FRESH one!"), (4, "another")], "pos int, phrase string")
    pool = M.phrase_pool(phrases, docs, ["pos"], 10)
    assert sorted((r.pick, r.phrase) for r in pool.collect()) == [(0, "fresh one"), (1, "another")]
    out = M.ranked_rewrite(docs, picks, pool, "id", "input", updates={"notes": F.concat(F.lit("rewritten "), F.col("pick").cast("string"))})
    got = {r.id: (r.input, r.notes, r.rewritten) for r in out.collect()}
    assert got[1] == ("fresh one", "rewritten 0", True) and got[3] == ("another", "rewritten 1", True)
    assert got[5] == ("tmpl 5", "n", False) and got[7] == ("tmpl 7", "n", False) and len(got) == 8


def test_topic_rewrite_falls_through(spark):
    df = spark.createDataFrame([(0, ["weed"], True), (1, ["weed"], True), (2, ["soil"], True), (3, [], False)], "pick int, topics array<string>, web boolean")
    out = M.topic_rewrite(df, {"weed": ("one {field}", "two {field}")}, {"field": ("n80", "creek")}, [(F.col("web"), "web {field}")], "off {field}", F.get("topics", F.lit(0)))
    assert [r.new_text for r in out.orderBy("pick").collect()] == ["one n80", "two creek", "web n80", "off creek"]


def test_candidates_are_normalised_once(spark):
    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    # The candidates are written before they meet the corpus, so each plan has the texts of one of them.
    alone = plan(M.unique_candidates(listed(spark, ["a"]), None))
    assert alone.count("md5(") == 1 and X.BLANK_KEY in alone
    assert plan(M.unique_candidates(listed(spark, ["a"]), spark.createDataFrame([("b",)], "input string"))).count("md5(") == 1
