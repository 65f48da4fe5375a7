import random

from pyspark.sql import functions as F

from labelmill.config import AGRONOMY, AGRONOMY_EVAL
from labelmill.operators import evaluate as L
from labelmill.operators.lexicon import lexicon_from_rows, lexicon_rows, rule_predict

FLAGS = AGRONOMY.spec.flags


def hits(text, words):
    return any(w in text for w in words)


def expected(text, cfg):
    """The same rules over one Python string."""
    low = text.lower()
    topics = [t for t, words in cfg.topic_keywords.items() if hits(low, words)]
    crops = [c for c, words in cfg.crop_keywords.items() if hits(low, words)]
    flags = {f for f, words in cfg.flag_keywords.items() if hits(low, words)}
    domain = bool(topics or crops or flags) and not hits(low, cfg.negative_hints)
    intents = [i for i, words in cfg.intent_keywords.items() if hits(low, words)]
    urgency = "high" if hits(low, cfg.urgent_keywords) else "medium" if domain or hits(low, cfg.soon_keywords) else "low"
    return {
        "is_ag_related": domain,
        **{f: domain and f in flags for f in cfg.spec.flags},
        "crops": ["both"] if len(crops) == 2 else crops or (["unknown"] if domain else []),
        "topics": topics or (["general_agronomy"] if domain else []),
        "intent": intents[0] if intents else "question" if not domain and "?" in low else "other",
        "urgency": urgency,
    }


def random_texts(cfg, n):
    rng = random.Random(7)
    pool = [w for lex in (cfg.flag_keywords, cfg.topic_keywords, cfg.crop_keywords, cfg.intent_keywords) for ws in lex.values() for w in ws]
    pool += ["movie", "hotel", "snow", "soon", "urgent", "zzz", "lorem", "?", "Rotation", "the", "CORN"]
    return [" ".join(rng.choice(pool) if rng.random() < 0.6 else "zz" for _ in range(rng.randint(0, 4))) for _ in range(n)]


def test_rules_match_brute_force_for_both_lexicons(spark):
    for cfg in (AGRONOMY, AGRONOMY_EVAL):
        texts = [*random_texts(cfg, 400), "", "zz?", "movie?", "corn movie", "game of beans now"]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, input string").repartition(4)
        got = {r["i"]: r.asDict() for r in rule_predict(df, cfg).collect()}
        for i, text in enumerate(texts):
            want = expected(text, cfg)
            assert {k: got[i][k] for k in want} == want, text


def test_prefix_and_columns_are_clean(spark):
    df = spark.createDataFrame([("corn",)], "input string")
    out = rule_predict(df, AGRONOMY, prefix="rule_")
    assert out.columns == ["input", *[f"rule_{c}" for c in ("is_ag_related", *AGRONOMY.flag_keywords, "crops", "topics", "intent", "urgency")]]


def test_router_lexicon_extends_the_evaluation_lexicon():
    for name, words in AGRONOMY_EVAL.flag_keywords.items():
        assert AGRONOMY.flag_keywords[name][: len(words)] == words
    assert "plant?" in AGRONOMY.flag_keywords["needs_weather_data"]
    assert AGRONOMY_EVAL.negative_hints == () and "movie" in AGRONOMY.negative_hints


def test_lexicon_table_round_trip():
    rows = lexicon_rows(AGRONOMY.topic_keywords, "topics")
    random.Random(1).shuffle(rows)
    back = lexicon_from_rows(sorted(rows, key=lambda r: lexicon_rows(AGRONOMY.topic_keywords, "topics").index(r)))
    assert back == AGRONOMY.topic_keywords


# Fixed expectation cases: (name, text, domain, crops, topics, flags); None is not checked.
CASES = [
    ("short_query_corn_yellow", "corn yellow", True, ["corn"], ["nutrient"], {"needs_rag": True, "needs_weather_data": False, "needs_farm_data": False}),
    ("vague_field_observation", "field looks bad", True, ["unknown"], None, {"needs_rag": False, "needs_farm_data": True}),
    ("mixed_market_and_planting", "price of corn and when should I plant?", True, ["corn"], ["management", "market_economics"],
     {"needs_web_search": True, "needs_weather_data": True}),
    ("non_ag_noise", "what time does the movie start tonight", False, None, None, dict.fromkeys(FLAGS, False)),
    ("weather_driven_spray_timing", "Should I spray before the rain tomorrow?", True, None, ["management", "weather"],
     {"needs_rag": True, "needs_weather_data": True, "needs_farm_data": True}),
    ("farm_specific_context", "Given this field's planting date and hybrid, should I sidedress this week?", True, None,
     ["management", "nutrient"], {"needs_rag": True, "needs_weather_data": True, "needs_farm_data": True}),
]


def test_expectation_cases_pass_by_rules(spark):
    schema = "name string, input string, exp_is_ag_related boolean, exp_crops array<string>, exp_topics array<string>, " + \
        ", ".join(f"exp_{f} boolean" for f in FLAGS)
    cases = spark.createDataFrame([(n, t, d, c, o, *[f.get(x) for x in FLAGS]) for n, t, d, c, o, f in CASES], schema)
    pred = rule_predict(cases.select("name", "input"), AGRONOMY)
    checked = L.check_expectations(cases.drop("input"), pred, ["is_ag_related", *FLAGS], ["crops", "topics"])
    assert {r["name"]: r["all_passed"] for r in checked.collect()} == {c[0]: True for c in CASES}
    assert tuple(L.expectation_summary(checked).first()) == (6, 6)
    missed = L.check_expectations(cases.drop("input").withColumn("exp_topics", F.array(F.lit("pest"))), pred, [], ["topics"])
    assert tuple(L.expectation_summary(missed).first()) == (0, 6)
