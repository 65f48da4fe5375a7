"""Physical plans that have to stay as they are at scale."""

import pytest
from pyspark.sql import functions as F

from labelmill.config import AGRONOMY, AGRONOMY_SPEC, ROUTER_THRESHOLDS, VAGUE_PHRASES
from labelmill.operators import logodds as H
from labelmill.operators import profile as P
from labelmill.operators import route as R
from labelmill.operators.lexicon import rule_predict


def plan_of(df):
    return whole_plan(df).split("Initial Plan")[0]


def whole_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "t")
    rows = [(i, f"corn w{i % 5} field w{i % 3}", i % 2 == 0, "unused") for i in range(60)]
    spark.createDataFrame(rows, "id int, input string, flag boolean, other string").write.parquet(path)
    return spark.read.parquet(path)


def test_routing_is_one_narrow_stage_without_python(spark, table):
    heads = [(i, h.field, h.label, h.label_pos, 0, h.threshold) for i, h in enumerate(H.heads_of(AGRONOMY_SPEC, ROUTER_THRESHOLDS))]
    weights = spark.createDataFrame([(0, "corn", 5), (3, "w1_field", -7)], H.WEIGHTS_SCHEMA)
    scorer = H.compile_model(H.TokenModel(spark.createDataFrame(heads, H.HEADS_SCHEMA), weights))
    texts, _ = R.split_blank(table.select("id", "input"))
    plan = plan_of(R.route(texts, scorer, AGRONOMY))
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan
    assert "from_json" not in plan, "the model index has to be folded to a literal"
    assert "ReadSchema: struct<id:int,input:string>" in plan


def test_fit_counts_features_once(spark, table):
    plan = whole_plan(H.fit(table, [H.Head("flag", "true", 0, F.col("flag"))], max_features=2, min_weight=0.0).weights)
    assert "ReusedExchange [feature" in plan and "WindowGroupLimit" in plan
    assert "ReadSchema: struct<input:string,flag:boolean>" in plan and "other" not in plan


def test_statistics_read_needed_columns_and_combine_before_the_shuffle(table):
    ruled = rule_predict(table.select("id", "input"), AGRONOMY).withColumn("difficulty", F.lit("hard"))
    plan = plan_of(P.corpus_stats(ruled, "is_ag_related", "needs_rag", VAGUE_PHRASES))
    assert "ReadSchema: struct<input:string>" in plan and "partial_count" in plan
    assert plan.count("Exchange SinglePartition") == 1


def test_combination_counts_evaluate_each_keyword_once(table):
    ruled = rule_predict(table.select("id", "input"), AGRONOMY)
    plan = plan_of(P.combo_minimums(ruled, AGRONOMY_SPEC.flags, [("none", (False,) * 4, 0)]))
    assert plan.count("Contains(__low") and plan.count(", lambsquarters)") <= 2
