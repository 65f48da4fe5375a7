import pytest
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators import evaluate as L

FLAGS = ("a", "b")
FIELDS = L.EvalFields(binary=FLAGS, classes=("kind",), sets={"topics": ("x", "y", "z")})
SCHEMA = ("id int, true_a boolean, pred_a boolean, true_b boolean, pred_b boolean, true_kind string, pred_kind string, "
          "true_topics array<string>, pred_topics array<string>")
T, N = True, False
ROWS = [
    (1, T, T, N, N, "p", "p", ["x", "y"], ["y", "x"]),   # exact, topics in another order
    (2, N, T, N, N, "p", "q", ["x"], ["x", "z"]),        # over
    (3, T, N, N, N, "q", "q", ["y"], []),                # under
    (4, T, N, N, T, "r", "p", [], ["x"]),                # mixed
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def metrics(df):
    return {(r.field, r.metric): r.value for r in df.collect()}


def test_all_metrics_by_hand(spark):
    got = metrics(L.evaluate(frame(spark), FIELDS))
    assert got[("a", "accuracy")] == 0.25 and got[("a", "precision")] == 0.5 and got[("a", "recall")] == 1 / 3 and got[("a", "f1")] == 0.4
    assert [got[("b", m)] for m in L.PRF] == [0.75, 0.0, 0.0, 0.0]
    # kinds: p tp1 fp1 fn1, q tp1 fp1 fn0, r tp0 fp0 fn1
    assert got[("kind", "accuracy")] == 0.5 and got[("kind", "precision")] == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert got[("kind", "recall")] == pytest.approx((0.5 + 1 + 0) / 3) and got[("kind", "f1")] == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    # topics: x tp2 fp1 fn0, y tp1 fp0 fn1, z tp0 fp1 fn0
    assert got[("topics", "accuracy")] == 0.25 and got[("topics", "precision")] == 3 / 5 and got[("topics", "recall")] == 3 / 4
    assert got[("topics", "micro_f1")] == got[("topics", "f1")] == 6 / 9
    assert got[("topics", "macro_precision")] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert got[("topics", "macro_recall")] == pytest.approx((1 + 0.5 + 0) / 3) and got[("topics", "macro_f1")] == pytest.approx((0.8 + 2 / 3) / 3)


def test_metrics_take_one_pass_over_the_rows(spark):
    plan = L.evaluate(frame(spark), FIELDS)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("ReusedExchange") >= 3


def test_unused_label_counts_as_zero_in_set_macro_only(spark):
    spec = L.EvalFields(classes=("kind",), sets={"topics": ("x", "y", "z", "never")})
    got = metrics(L.evaluate(frame(spark), spec))
    assert got[("topics", "macro_precision")] == pytest.approx((2 / 3 + 1) / 4)
    assert got[("kind", "recall")] == pytest.approx(0.5)


def test_no_rows(spark):
    empty = frame(spark, [])
    assert L.evaluate(empty, FIELDS).count() == 0
    assert tuple(L.decision_rates(L.add_decision(empty, FLAGS)).first()) == (0.0, 0.0, 0.0, 0.0)
    assert {r.n for r in L.confusion(empty, "kind", ("p", "q")).collect()} == {0}


def test_confusion_is_dense(spark):
    got = {(r.true_label, r.pred_label): r.n for r in L.confusion(frame(spark), "kind", ("p", "q", "r", "s")).collect()}
    assert len(got) == 16 and got[("p", "p")] == 1 and got[("r", "p")] == 1 and got[("s", "s")] == 0


def test_decisions_rates_and_breakdown(spark):
    decided = L.add_decision(frame(spark), FLAGS)
    assert [r.decision for r in decided.orderBy("id").collect()] == ["correct", "over", "under", "mixed"]
    assert tuple(L.decision_rates(decided).first()) == (0.25, 0.25, 0.25, 0.25)
    groups = {"topic": X.default_list(F.col("true_topics")), "kind": F.array("true_kind")}
    rows = L.decision_breakdown(decided, groups)
    got = {(r.group_name, r.group_key): (r.total, r.correct, r.over, r.under, r.mixed, r.correct_rate) for r in rows.collect()}
    assert got[("topic", "x")] == (2, 1, 1, 0, 0, 0.5) and got[("topic", "none")] == (1, 0, 0, 0, 1, 0.0)
    assert sum(v[0] for k, v in got.items() if k[0] == "topic") == 5
    worst = [(r.group_key, r.position) for r in L.worst_groups(rows, 2).filter("group_name = 'kind'").orderBy("position").collect()]
    assert worst == [("q", 1), ("r", 2)]


def test_error_records_compare_sets_unless_ordered(spark):
    got = sorted((r.id, r.label, r.error_type, r.true_value, r.pred_value) for r in L.error_records(frame(spark), FIELDS, ["id"]).collect())
    assert got == [
        (2, "a", "false_positive", "0", "1"), (2, "kind", "mismatch", "p", "q"), (2, "topics", "set_mismatch", "x", "x, z"),
        (3, "a", "false_negative", "1", "0"), (3, "topics", "set_mismatch", "y", "none"),
        (4, "a", "false_negative", "1", "0"), (4, "b", "false_positive", "0", "1"), (4, "kind", "mismatch", "r", "p"),
        (4, "topics", "set_mismatch", "none", "x")]
    ordered = L.error_records(frame(spark), FIELDS, ["id"], ordered=True)
    assert ordered.filter("id = 1").count() == 1


def test_error_counts_hotspots_and_examples(spark):
    errors = L.error_records(frame(spark), FIELDS, ["id"])
    counts = L.error_counts(errors, {"label": F.col("label"), "id": F.col("id")})
    got = {(r.group_name, r.group_key): r.n for r in counts.collect()}
    assert got[("label", "a")] == 3 and got[("id", "4")] == 4
    assert [(r.group_key, r.n) for r in L.hotspots(counts, 1).orderBy("group_name").collect()] == [("4", 4), ("a", 3)]
    picks = L.error_examples(errors, [F.col("id"), F.col("label_pos")], {"all": 3, "false_negative": 1})
    assert sorted((r.list_name, r.position, r.id, r.label) for r in picks.collect()) == [
        ("all", 1, 2, "a"), ("all", 2, 2, "kind"), ("all", 3, 2, "topics"), ("false_negative", 1, 3, "a")]


def test_compare_metric_tables(spark):
    one = spark.createDataFrame([("a", "f1", 0.5), ("topics", "f1", 0.9), ("topics", "micro_f1", 0.1), ("k", "f1", 0.3)], "field string, metric string, value double")
    two = spark.createDataFrame([("a", "f1", 0.25), ("topics", "micro_f1", 0.4), ("k", "f1", 0.3)], "field string, metric string, value double")
    got = {r.field: (r.metric, r.winner, round(r.delta, 6)) for r in L.compare_metrics(one, two, ["topics"]).collect()}
    assert got == {"a": ("f1", "model", 0.25), "topics": ("micro_f1", "rules", -0.3), "k": ("f1", "tie", 0.0)}


def test_prediction_frame_joins_on_the_key(spark):
    truth = spark.createDataFrame([(1, "t1", ["x"], "p"), (2, "t2", [], "q")], "id int, input string, topics array<string>, kind string")
    pred = spark.createDataFrame([(2, ["y"], "q"), (1, ["x"], "p"), (3, [], "r")], "id int, topics array<string>, kind string")
    rows = L.prediction_frame(truth, pred, ["topics", "kind"], split="test").orderBy("id").collect()
    assert [(r.id, r.split, r.true_kind, r.pred_kind, r.pred_topics, r.topic_count) for r in rows] == [
        (1, "test", "p", "p", ["x"], 1), (2, "test", "q", "q", ["y"], 0)]
