import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelmill.functions import text as X


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("t"))).collect()]


def python_normalize(text):
    return re.sub(r"[^a-z0-9? ]", "", re.sub(r"\s+", " ", text.strip().lower()))


SPACES = ["a b", "a\x85 b", "\x0ba\x0b", "\x1ca\x1fb\x1c", "　 a  b", "", " \t\n", "a - b", "Side-Dress?"]


def test_normalize_matches_python_on_traps(spark):
    texts = [*SPACES, "éoff", "x off.", "it's OK", "tab\tand  two"]
    assert column(spark, texts, X.normalize_text) == [python_normalize(t) for t in texts]


def test_normalize_keeps_doubled_spaces_after_deleting(spark):
    assert column(spark, ["a - b"], X.normalize_text) == ["a  b"]


ALPHABET = st.sampled_from("aB9?é-'_ \t\n\x0b\x1c\x85  　ß")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=20), min_size=30, max_size=30))
def test_normalize_and_word_count_match_python(spark, texts):
    assert column(spark, texts, X.normalize_text) == [python_normalize(t) for t in texts]
    assert column(spark, texts, X.word_count) == [len(t.split()) for t in texts]


def test_short_texts(spark):
    assert column(spark, ["a b c d e", "a b c d e f", " "], X.is_short) == [True, False, True]


def test_phrases_need_unicode_word_boundaries(spark):
    phrases = ("off", "now what")
    found = column(spark, ["x off.", "éoff", "off", "offset", "so now what", "snow what"], lambda t: X.has_phrase(t, phrases))
    assert found == [True, False, True, False, True, False]


def test_keywords_are_plain_substrings(spark):
    words = ("now", "plant?", "side-dress", "a.c")
    found = column(spark, ["snow", "plant", "plant?", "xside-dressx", "abc"], lambda t: X.any_keyword(t, words))
    assert found == [True, False, True, True, False]


def test_large_and_empty_lexicons(spark):
    words = [f"word{i:04d}" for i in range(X.OR_CHAIN_LIMIT + 50)]
    assert column(spark, ["x word0290 y", "none"], lambda t: X.any_keyword(t, words)) == [True, False]
    assert column(spark, ["x"], lambda t: X.any_keyword(t, ())) == [False]


def test_features_are_sorted_distinct_unigrams_and_bigrams(spark):
    df = spark.createDataFrame([("It's it's A-b",), ("one",), ("--",)], "input string")
    rows = [r.features for r in X.add_features(df, ordered=True).collect()]
    assert rows == [["a", "a_b", "b", "it's", "it's_a", "it's_it's"], ["one"], []]


def test_math_is_safe_at_the_ends(spark):
    df = spark.createDataFrame([(-1000.0,), (0.0,), (1000.0,)], "x double")
    assert [r[0] for r in df.select(X.sigmoid(F.col("x"))).collect()] == [0.0, 0.5, 1.0]
    df = spark.createDataFrame([(0, 0), (3, 4)], "a bigint, b bigint")
    assert [tuple(r) for r in df.select(X.safe_div(F.col("a"), F.col("b")), X.ratio(F.col("a"), F.col("b"))).collect()] == [(0.0, 0.0), (0.75, 0.75)]


def test_clamps(spark):
    df = spark.createDataFrame([(0.1,), (0.9,)], "x double")
    assert [tuple(r) for r in df.select(X.clamp_up(F.col("x"), 0.85), X.clamp_down(F.col("x"), 0.2)).collect()] == [(0.85, 0.1), (0.9, 0.2)]


def test_lists(spark):
    df = spark.createDataFrame([(["b", "a"], ["a", "b"]), ([], None), (["a", "a"], ["a"])], "a array<string>, b array<string>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(X.lists_differ(a, b), X.lists_differ(a, b, ordered=True), X.join_list(a), X.default_list(b), X.join_list(b)).collect()
    assert [tuple(r) for r in rows] == [
        (False, True, "b, a", ["a", "b"], "a, b"), (True, True, "none", ["none"], "none"), (True, True, "a, a", ["a"], "a")]


def test_containment_and_union(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"]), (["a"], ["a", "c"]), (["a"], [])], "a array<string>, e array<string>")
    rows = df.select(X.contains_all(F.col("a"), F.col("e")), X.sorted_union(F.col("a"), F.col("e"))).collect()
    assert [tuple(r) for r in rows] == [(True, ["a", "b"]), (False, ["a", "c"]), (True, ["a"])]


def test_multi_hot_round_trip_and_unknown_labels(spark):
    space = ("x", "y", "z")
    df = spark.createDataFrame([(["z", "x"],), ([],)], "v array<string>")
    coded = df.select(X.multi_hot(F.col("v"), space).alias("h")).select("h", X.decode_hot(F.col("h"), space).alias("d"))
    assert [(r.h, r.d) for r in coded.collect()] == [([1, 0, 1], ["x", "z"]), ([0, 0, 0], [])]
    bad = spark.createDataFrame([(["q"],)], "v array<string>")
    assert bad.select(X.unknown_labels(F.col("v"), space)).first()[0] == ["q"]
    try:
        bad.select(X.multi_hot(F.col("v"), space)).collect()
    except Exception as error:
        assert "labels outside the space: q" in str(error)
    else:
        raise AssertionError("unknown label was accepted")


def test_label_vectors(spark):
    df = spark.createDataFrame([(["a"], True)], "l array<string>, f boolean")
    assert tuple(df.select(X.label_vector(F.col("l"), True), X.label_vector(F.col("f"), False)).first()) == (["a"], ["true"])


def test_ids_templates_and_cycles(spark):
    df = spark.createDataFrame([(7, "route_000041"), (1234567, "route_1")], "n bigint, id string")
    rows = df.select(X.build_id(F.col("n")), X.id_number(F.col("id")), X.cyclic_pick(("a", "b", "c"), F.col("n")),
                     X.fill_template(F.lit("{x} at {y}"), x=F.lit("corn"), y=F.lit("a.b$1")), X.lower_first(F.lit("Éab Cd"))).collect()
    assert [tuple(r) for r in rows] == [
        ("route_000007", 41, "b", "corn at a.b$1", "éab Cd"), ("route_1234567", 1, "b", "corn at a.b$1", "éab Cd")]


def test_reviewer_entries(spark):
    raw = [" Yes ", "no", "", None, "T", "1", "maybe", " "]
    assert column(spark, raw, lambda t: X.parse_bool(t, F.lit(True))) == [True, False, True, True, True, True, False, True]
    lists = [" a, ,b ,", "", None, "  ", ","]
    assert column(spark, lists, lambda t: X.parse_list(t, X.label_array(["kept"]))) == [["a", "b"], ["kept"], ["kept"], ["kept"], []]
    assert column(spark, [" x ", " ", None], lambda t: X.parse_text(t, F.lit("kept"))) == ["x", "kept", "kept"]


def test_fingerprint_is_never_null(spark):
    keys = column(spark, [None, " ", "A b", "a  B!"], X.fingerprint)
    assert keys[0] == "" and keys[1] == X.BLANK_KEY and keys[2] == keys[3]
