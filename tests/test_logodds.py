import math
import random
import re

import pytest
from pyspark.sql import functions as F

from labelmill.config import AGRONOMY, ROUTER_THRESHOLDS, Thresholds
from labelmill.operators import logodds as H
from labelmill.operators import route as R


def features(text):
    words = re.findall(r"[a-z0-9']+", text.lower())
    return set(words) | {f"{a}_{b}" for a, b in zip(words, words[1:])}


def brute_fit(rows, members, k=120, minimum=0.15):
    """Bias and weights per head over a list of texts, in units of 1e-4."""
    out = []
    for member in members:
        inside = [features(t) for t, row in rows if member(row)]
        outside = [features(t) for t, row in rows if not member(row)]
        bias = math.log((len(inside) + 1) / (len(outside) + 1))
        scored = []
        for f in set().union(*inside, *outside):
            p, n = sum(f in d for d in inside) + 1, sum(f in d for d in outside) + 1
            if abs(math.log(p / n)) >= minimum:
                scored.append((max(p, n) / min(p, n), f, round(math.log(p / n) * 10000)))
        out.append((round(bias * 10000), {f: w for _, f, w in sorted(scored, reverse=True)[:k]}))
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["corn", "it's", "rare1"]
    return [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice("abc"), rng.random() < 0.3) for _ in range(n)]


def make_heads():
    return [H.Head("flag", "true", 0, F.col("flag"))] + [H.Head("kind", k, i, F.col("kind") == k) for i, k in enumerate("abcd")]


MEMBERS = [lambda r: r[1]] + [lambda r, k=k: r[0] == k for k in "abcd"]


@pytest.mark.parametrize("n,k,screen", [(12, 120, 8), (150, 120, 8), (150, 20, 2), (150, 5, 30), (60, 10, 1000)])
def test_fit_matches_brute_force(spark, n, k, screen):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "input string, kind string, flag boolean").repartition(3)
    counts = H.feature_counts(df, make_heads())
    best = H.strongest(counts, 5, k=k, screen=screen).select("head", "feature", F.round(F.col("raw") * 10000).cast("bigint").alias("w"))
    got = {}
    for r in best.collect():
        got.setdefault(r["head"], {})[r["feature"]] = r["w"]
    want = brute_fit([(t, (kind, flag)) for t, kind, flag in rows], MEMBERS, k)
    assert [got.get(i, {}) for i in range(5)] == [w for _, w in want]
    biases = {r["head"]: r["bias"] for r in H.fit(df, make_heads()).heads.collect()}
    assert [biases[i] for i in range(5)] == [b for b, _ in want]


def test_equal_strengths_keep_the_largest_features(spark):
    names = [f"f{i:03d}" for i in range(121)]
    df = spark.createDataFrame([(n, True) for n in names] + [("", False)], "input string, flag boolean")
    kept = {r["feature"] for r in H.fit(df, make_heads()[:1]).weights.collect()}
    assert kept == set(names[1:])


def test_inline_and_join_scores_match_brute_force(spark):
    rows = corpus(80)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, input string, kind string, flag boolean")
    model = H.fit(df, make_heads())
    scorer = H.compile_model(model)
    fresh = [(i, t) for i, (t, _, _) in enumerate(corpus(40, 9))] + [(100, "unseen only"), (101, "")]
    texts = spark.createDataFrame(fresh, "id int, input string")
    inline = {r["id"]: r["score_sums"] for r in H.score_inline(texts, scorer).collect()}
    joined = {}
    for r in H.score_join(texts, model, "id").collect():
        joined.setdefault(r["id"], {})[r["head"]] = r["total"]
    want = brute_fit([(t, (kind, flag)) for t, kind, flag in rows], MEMBERS)
    for i, text in fresh:
        sums = [bias + sum(weights.get(f, 0) for f in features(text)) for bias, weights in want]
        assert inline[i] == sums and [joined[i][h] for h in range(5)] == sums


def test_large_models_drop_foreign_features_before_the_shuffle(spark):
    """200 labels: the weights are not broadcast, and all ways to score give the same rows."""
    rng = random.Random(4)
    heads = [(i, "label", f"l{i}", i, i - 100, 0.5) for i in range(200)]
    weights = [(i, f"w{rng.randrange(400)}", rng.randint(-900, 900)) for i in range(200) for _ in range(20)]
    weights = sorted({(h, f): w for h, f, w in weights}.items())
    model = H.TokenModel(spark.createDataFrame(heads, H.HEADS_SCHEMA), spark.createDataFrame([(h, f, w) for (h, f), w in weights], H.WEIGHTS_SCHEMA))
    rows = [(i, " ".join(f"{rng.choice('wx')}{rng.randrange(900)}" for _ in range(rng.randint(0, 30)))) for i in range(60)]
    texts = spark.createDataFrame([*rows, (60, None), (61, "w1 " * 50)], "id int, input string").repartition(4)
    inline = {r["id"]: r["score_sums"] for r in H.score_inline(texts, H.compile_model(model)).collect()}
    for limit in (10, 100_000):
        sums, _ = H.score_arrays(texts, model, "id", broadcast_weights=limit)
        assert {r["id"]: r["score_sums"] for r in sums.collect()} == {i: s for i, s in inline.items()}
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert ("getbit" in plan) == (limit == 10) and ("SortMergeJoin [feature" in plan) == (limit == 10)
    test = H.feature_filter(model.weights)
    probes = spark.createDataFrame([(f"w{i}",) for i in range(400)] + [(f"y{i}",) for i in range(4000)], "feature string").withColumn("may", test(F.col("feature")))
    may = {r.feature for r in probes.filter("may").collect()}
    assert {f for (_, f), _ in weights} <= may and sum(f[0] == "y" for f in may) < 120
    tight = H.feature_filter(model.weights, max_bits=1024)
    assert probes.filter(tight(F.col("feature"))).filter(F.col("feature").isin([f for (_, f), _ in weights])).count() == len({f for (_, f), _ in weights})
    assert probes.filter(H.feature_filter(model.weights.limit(0))(F.col("feature"))).count() == 0


def test_large_models_are_not_inlined(spark):
    df = spark.createDataFrame(corpus(30), "input string, kind string, flag boolean")
    model = H.fit(df, make_heads())
    assert H.compile_model(model, limit=10) is None


def scorer_of(spark, heads, weights):
    model = H.TokenModel(spark.createDataFrame(heads, H.HEADS_SCHEMA), spark.createDataFrame(weights, H.WEIGHTS_SCHEMA))
    return model, H.compile_model(model)


def test_decisions_thresholds_and_ties(spark):
    heads = [(0, "f", "true", 0, 0, 0.5), (1, "g", "true", 0, -1, 0.5), (2, "topics", "x", 0, 0, 0.5), (3, "topics", "y", 1, -1, 0.5),
             (4, "kind", "p", 0, 5, 0.5), (5, "kind", "q", 1, 5, 0.5), (6, "kind", "r", 2, 4, 0.5)]
    model, scorer = scorer_of(spark, heads, [(5, "push", 1)])
    texts = spark.createDataFrame([("none",), ("push it",)], "input string")
    out = H.add_decisions(H.score_inline(texts, scorer).withColumn("score_probs", H.probabilities()), scorer).collect()
    assert [(r.model_f, r.model_g, r.model_topics, r.model_kind) for r in out] == [
        (True, False, ["x"], "p"), (True, False, ["x"], "q")]


def test_model_round_trip_and_missing_model(spark, tmp_path):
    df = spark.createDataFrame(corpus(30), "input string, kind string, flag boolean")
    model = H.fit(df, make_heads())
    H.save_model(model, str(tmp_path / "m"))
    back = H.load_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.weights.collect())) == sorted(map(tuple, model.weights.select("head", "feature", "weight").collect()))
    assert sorted(r["bias"] for r in back.heads.collect()) == sorted(r["bias"] for r in model.heads.collect())
    with pytest.raises(FileNotFoundError, match="no token model"):
        H.load_model(spark, str(tmp_path / "absent"))


def test_min_df_is_an_option(spark):
    df = spark.createDataFrame([("a b", "a", True), ("a", "b", False)], "input string, kind string, flag boolean")
    assert {r["feature"] for r in H.feature_counts(df, make_heads(), min_df=2).collect()} == {"a"}


# --- routing -----------------------------------------------------------------------

def agronomy_model(spark, **bias):
    heads = H.heads_of(AGRONOMY.spec, ROUTER_THRESHOLDS)
    rows = [(i, h.field, h.label, h.label_pos, bias.get(h.field if h.label == "true" else h.label, -20000), h.threshold) for i, h in enumerate(heads)]
    return scorer_of(spark, rows, [(0, "zebra", 30000)])


def routed(spark, texts, **bias):
    model, scorer = agronomy_model(spark, **bias)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, input string")
    a = R.route(df, scorer, AGRONOMY).orderBy("id")
    b = R.route_join(df, model, AGRONOMY, "id").select(*a.columns).orderBy("id")
    rows = a.collect()
    assert rows == b.collect()
    return rows


def test_rules_decide_the_domain_and_model_fills_in(spark):
    inside, outside = routed(spark, ["corn yellow", "zebra movie"], needs_web_search=10000, soil=10000, monitoring=5000, is_ag_related=20000)
    assert inside.is_ag_related and inside.crops == ["corn"] and inside.topics == ["nutrient", "soil"]
    assert inside.needs_rag and inside.needs_web_search and not inside.needs_farm_data
    assert inside.intent == "monitoring" and inside.urgency == "medium"
    assert inside.conf_needs_rag == 0.8 and inside.conf_crops["corn"] == 0.82 and inside.conf_topics["nutrient"] == 0.78
    assert inside.conf_topics["soil"] == 0.7311 and inside.conf_urgency["medium"] == 0.72 and inside.conf_is_ag_related == 0.8808
    assert not outside.is_ag_related and outside.crops == [] and outside.topics == [] and not outside.needs_web_search
    assert outside.urgency == "low" and outside.intent == "monitoring"
    assert outside.conf_is_ag_related == 0.2 and outside.conf_needs_web_search == 0.2 and outside.conf_topics["soil"] == 0.7311


def test_rule_intent_wins_unless_it_is_the_fallback(spark):
    asked, plain = routed(spark, ["should i spray corn", "corn"], comparison=9000)
    assert asked.intent == "planning" and plain.intent == "comparison"
    assert asked.conf_intent["planning"] == 0.72 and asked.conf_intent["comparison"] == 0.7109


def test_model_domain_without_topic_adds_the_default(spark):
    (row,) = routed(spark, ["corn yellow"], is_ag_related=20000)
    assert row.topics == ["general_agronomy", "nutrient"]
    (row,) = routed(spark, ["corn yellow"])
    assert row.topics == ["nutrient"]


def test_blank_texts_are_split_off(spark):
    df = spark.createDataFrame([(1, " corn "), (2, "  "), (3, None)], "id int, input string")
    texts, blank = R.split_blank(df)
    assert [(r.id, r.input) for r in texts.collect()] == [(1, "corn")]
    assert sorted(r.id for r in blank.collect()) == [2, 3]


def test_models_of_any_size_are_routed(spark, monkeypatch):
    model, scorer = agronomy_model(spark, soil=10000)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["corn yellow", "zebra movie", "zebra corn", "x"])], "id int, input string")
    want = R.route(df, scorer, AGRONOMY).orderBy("id").collect()
    monkeypatch.setattr(H, "compile_model", lambda m: None)
    for most in (H.BROADCAST_WEIGHTS, 0):
        monkeypatch.setattr(H, "BROADCAST_WEIGHTS", most)
        got = R.route(df, model, AGRONOMY)
        assert got.select(*want[0].__fields__).orderBy("id").collect() == want


def test_default_thresholds():
    assert ROUTER_THRESHOLDS.of("needs_rag") == 0.52 and ROUTER_THRESHOLDS.of("topics") == 0.42
    assert Thresholds().of("anything") == 0.5


@pytest.mark.parametrize("names", [["a", "a_b", "b_b", "it's_c", "x_y_z", "_b"], ["a", "c"], ["a_b"]])
def test_features_are_dropped_before_they_are_put_together_and_made_distinct(spark, names):
    heads = spark.createDataFrame([(i, f, "true", 0, 10 * i, 0.5) for i, f in enumerate("pq")], H.HEADS_SCHEMA)
    weights = spark.createDataFrame([(i % 2, f, 3 ** i) for i, f in enumerate(names)], H.WEIGHTS_SCHEMA)
    model = H.TokenModel(heads, weights)
    texts = spark.createDataFrame(enumerate(["a b A_b a b b b", "it's c it's c", "a", "b a", "", None, "x y z _b x_y_z", "B!b"]), "id long, input string")
    scored = H.score_inline(texts, H.compile_model(model))
    joined = H.score_arrays(texts, model, "id")[0]
    assert {r.id: r.score_sums for r in scored.collect()} == {r.id: r.score_sums for r in joined.collect()}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(filter(" in plan or "array_distinct(concat(filter(" in plan
