import json

import pytest
from pyspark.sql import functions as F

from labelmill.config import AGRONOMY_SPEC
from labelmill.operators import corpus as C
from labelmill.sources import files

SPEC = AGRONOMY_SPEC


def row(i, text):
    labels = {"is_ag_related": True, "crops": ["corn"], "topics": ["soil"], **dict.fromkeys(SPEC.flags, False), "intent": "question", "urgency": "low"}
    return {"id": f"route_{i:06d}", "input": text, "labels": labels, "meta": {"source_type": "synthetic", "difficulty": "hard", "notes": "n"}}


@pytest.fixture()
def folder(tmp_path):
    for i, name in enumerate(("train", "val")):
        lines = [json.dumps(row(10 * i + j, f"é {name} {j}"), ensure_ascii=False) for j in range(3)]
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(lines) + "\n", encoding="utf-8")
    return tmp_path


def test_splits_are_tagged_from_file_names(spark, folder):
    df = files.read_splits(spark, [str(folder / "train.jsonl"), str(folder / "val.jsonl")], SPEC)
    got = sorted((r.split, r.split_pos, r.id, r.input, r.crops) for r in df.collect())
    assert got[0] == ("train", 1, "route_000000", "é train 0", ["corn"]) and got[5][:3] == ("val", 2, "route_000012") and len(got) == 6


def test_one_split_and_plain_jsonl(spark, folder):
    assert files.read_split(spark, str(folder / "val.jsonl"), SPEC).count() == 3
    assert files.read_jsonl(spark, str(folder / "val.jsonl"), "id string").columns == ["id"]


def test_corpus_round_trip_refuses_to_overwrite(spark, folder, tmp_path):
    flat = files.read_splits(spark, [str(folder / "train.jsonl"), str(folder / "val.jsonl")], SPEC)
    out = str(tmp_path / "out")
    files.write_corpus(C.nest(flat, SPEC), out)
    back = spark.read.schema(C.corpus_schema(SPEC)).json(f"{out}/split=val")
    assert sorted(r.input for r in back.collect()) == ["é val 0", "é val 1", "é val 2"] and back.first().labels.topics == ["soil"]
    with pytest.raises(Exception, match="already exists"):
        files.write_corpus(C.nest(flat, SPEC), out)


def test_predictions_as_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x,y")], "id int, pred_topics array<string>, t string")
    files.write_predictions(df, str(tmp_path / "j"))
    files.write_predictions(df, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).first().pred_topics == ["a", "b"]
    assert spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "c")).first().t == "x,y"


def test_metrics_feedback_and_log_files(spark, tmp_path):
    files.write_metrics(spark.createDataFrame([("a", "f1", 0.5)], "field string, metric string, value double"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().value == 0.5
    (tmp_path / "f.jsonl").write_text(json.dumps(row(1, "t") | {"meta": {"review_count": 2, "feedback": "correct"}}) + "\n", encoding="utf-8")
    assert files.read_feedback(spark, str(tmp_path / "f.jsonl"), SPEC).first().meta.review_count == 2
    events = spark.createDataFrame([("a",), ("b",)], "id string").withColumn("entry_type", F.lit("inference"))
    for event in ("a", "b"):
        files.append_log(events.filter(F.col("id") == event), str(tmp_path / "log"))
    assert sorted(r.id for r in files.read_log(spark, str(tmp_path / "log"), SPEC).collect()) == ["a", "b"]


def test_embedding_cache_appends(spark, tmp_path):
    df = spark.createDataFrame([("k", [1.0])], "content_key string, embedding array<double>")
    files.write_embeddings(df, str(tmp_path / "e"))
    files.write_embeddings(df.withColumn("content_key", F.lit("l")), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
