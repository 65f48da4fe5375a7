import json

import pytest

from labelmill import config as G
from labelmill.__main__ import main
from labelmill.operators import logodds as H
from labelmill.plans import jobs
from labelmill.sources import files

TEXTS = [
    ("corn yellow in the field", True, ["corn"], ["nutrient"], {"needs_rag": True, "needs_farm_data": True}, "question", "medium"),
    ("movie tonight?", False, [], [], {}, "question", "low"),
    ("will it rain on beans tomorrow", True, ["soybean"], ["weather"], {"needs_weather_data": True}, "planning", "high"),
    ("price of corn today", True, ["corn"], ["market_economics"], {"needs_web_search": True}, "information_lookup", "high"),
    ("recipe for soup", False, [], [], {}, "other", "low"),
    ("soil test for north 80", True, ["unknown"], ["soil"], {"needs_farm_data": True}, "information_lookup", "low"),
]


def write(path, spec, start=0, repeat=1):
    lines = []
    for i in range(len(TEXTS) * repeat):
        text, domain, crops, topics, flags, intent, urgency = TEXTS[i % len(TEXTS)]
        labels = {"is_ag_related": domain, "crops": crops, "topics": topics, **{f: flags.get(f, False) for f in spec.flags}, "intent": intent, "urgency": urgency}
        tail = f" {i}" if i >= len(TEXTS) or start else ""
        lines.append(json.dumps({"id": f"route_{start + i:06d}", "input": text + tail, "labels": labels,
                                 "meta": {"source_type": "synthetic", "difficulty": ("hard", "simple")[i % 2], "notes": "n"}}))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


@pytest.fixture()
def paths(tmp_path):
    return [write(tmp_path / "train.jsonl", G.AGRONOMY_SPEC, 0, 4), write(tmp_path / "val.jsonl", G.AGRONOMY_SPEC, 100)]


def test_validation_goes_on_after_bad_lines(spark, tmp_path):
    spec = G.AGRONOMY_SPEC_5
    path = tmp_path / "train.jsonl"
    write(path, spec, 0, 2)
    lines = path.read_text(encoding="utf-8").splitlines()
    wrong = json.loads(lines[5])
    del wrong["labels"]["needs_rag"]
    odd = json.loads(lines[6])
    odd["labels"]["needs_epa_label"], odd["labels"]["intent"] = "true", "dance"
    lines[5:7] = [json.dumps(wrong), json.dumps(odd)]
    lines.insert(2, '{"id": broken')
    lines.insert(4, "")
    path.write_text("\n".join(lines), encoding="utf-8")
    tables = jobs.validate(spark, [str(path)], spec, None, [("train", 12)])
    assert sorted((r.file, r.line_no, r.rule) for r in tables["line_violations"].collect()) == [
        ("train.jsonl", 3, "bad_json"), ("train.jsonl", 5, "blank_line"), ("train.jsonl", 8, "$.labels: missing keys"), ("train.jsonl", 9, "$.labels.needs_epa_label: not boolean")]
    assert [(r.line_no, r.rule) for r in tables["violations"].collect()] == [(9, "unknown_intent")]
    assert tables["stats"].first().total == 12
    with pytest.raises(ValueError, match="bad_json=1"):
        jobs.gate(tables)


def test_validate_job_and_gate(spark, tmp_path):
    spec = G.AGRONOMY_SPEC_5
    data = [write(tmp_path / "train.jsonl", spec, 0, 2), write(tmp_path / "val.jsonl", spec, 100)]
    schema = {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^route_[0-9]{6}$"}}}
    tables = jobs.validate(spark, data, spec, schema, [("train", 12), ("val", 6)])
    assert tables["violations"].count() == 0 and tables["line_violations"].count() == 0
    assert tables["splits"].filter("not ok").count() == 0 and tables["stats"].first().total == 18
    assert tables["coverage"].count() == 12
    with pytest.raises(ValueError, match="combo:weather_only"):
        jobs.gate(tables)
    with pytest.raises(ValueError, match="split sizes differ: val"):
        jobs.gate(jobs.validate(spark, data, spec, None, [("train", 12), ("val", 7)]))


def test_report_and_audit(spark, paths):
    corpus = files.read_splits(spark, paths, G.AGRONOMY_SPEC)
    out = jobs.report(corpus, G.AGRONOMY_SPEC, G.AUDIT_COMBOS)
    assert {(r.field, r.value): r.n for r in out["scalars"].collect()}[("split", "val")] == 6
    assert {r["class"] for r in out["samples"].collect()} == {"outside", "hard", "weather_only", "web_only", "farm_only", "rag_plus_farm"}
    assert out["warnings"].count() > 0 and out["duplicates"].count() == 0 and out["light_topics"].count() > 0
    old, new = corpus.filter("split = 'train'"), corpus
    found = jobs.audit(old, new)
    assert {r.metric: (r.before, r.after) for r in found["diff"].collect()}["total"] == (24.0, 30.0)
    kinds = {(r.kind, r.subject) for r in found["findings_after"].collect()}
    assert ("missing_combo", "rag_plus_weather") in kinds and ("sparse_combo", "weather_only") in kinds


def test_train_predict_evaluate_compare(spark, paths, tmp_path):
    corpus = files.read_splits(spark, paths, G.AGRONOMY_SPEC)
    jobs.train(corpus, str(tmp_path / "model"))
    pred = jobs.predict(corpus, H.load_model(spark, str(tmp_path / "model")))
    frame = jobs.frame_of(corpus, pred, G.AGRONOMY_SPEC, "all").cache()
    assert frame.count() == 30
    out = jobs.evaluate(frame)
    metrics = {(r.field, r.metric): r.value for r in out["metrics"].collect()}
    assert metrics[("is_ag_related", "accuracy")] == 1.0 and metrics[("crops", "micro_f1")] == 1.0
    assert sum(r.n for r in out["confusion_needs_rag"].collect()) == 30 and out["confusion_intent"].count() == 64
    compared = jobs.compare_with_rules(corpus, pred)["comparison"].collect()
    assert {r.field for r in compared} == {"is_ag_related", *G.FLAGS_4, "crops", "topics", "intent", "urgency"}
    assert all(r.metric == ("micro_f1" if r.field in ("crops", "topics") else "f1") for r in compared)
    routing = jobs.analyse_routing(frame)
    assert sum(routing["rates"].first()) == pytest.approx(1.0) and routing["worst"].count() > 0
    errors = jobs.analyse_errors(frame)
    assert errors["counts"].filter("group_name = 'label'").groupBy().sum("n").first()[0] == errors["errors"].count()


def test_command_line_jobs(spark, paths, tmp_path):
    main(["train", "--data", *paths, "--out", str(tmp_path / "m")])
    main(["evaluate", "--data", paths[1], "--model", str(tmp_path / "m"), "--out", str(tmp_path / "e")])
    assert spark.read.json(str(tmp_path / "e" / "metrics")).count() == 5 * 4 + 2 * 8 + 2 * 4
    with pytest.raises(SystemExit):
        main(["errors", "--data", paths[1], "--out", str(tmp_path / "x")])
    with pytest.raises(ValueError):
        main(["validate", "--data", *paths, "--out", str(tmp_path / "v")])
    assert spark.read.json(str(tmp_path / "v" / "checks")).count() == 12
    events = [{"id": "a", "interaction_id": "a", "entry_type": "inference", "timestamp": "t1", "input": "x",
               "prediction": {"is_ag_related": True, "crops": ["corn"], "topics": [], "intent": "question"}},
              {"id": "r", "interaction_id": "a", "entry_type": "review", "timestamp": "t2", "user_feedback": "incorrect",
               "corrected_labels": {"is_ag_related": False, "crops": [], "topics": [], "intent": "question"}}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, events)), encoding="utf-8")
    main(["failures", "--data", str(tmp_path / "log.jsonl"), "--out", str(tmp_path / "f")])
    assert spark.read.json(str(tmp_path / "f" / "patterns")).first().pattern == "crops, is_ag_related"
    main(["feedback", "--data", str(tmp_path / "log.jsonl"), "--out", str(tmp_path / "g")])
    assert spark.read.json(str(tmp_path / "g" / "feedback")).first().id == "feedback_a"


def test_repeats_inside_one_split_are_found(spark, tmp_path):
    path = write(tmp_path / "train.jsonl", G.AGRONOMY_SPEC_5)
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([lines[0], "", lines[1], lines[0], lines[2].replace("synthetic", "bogus"), lines[1]]) + "\n")
    found = {(r.line_no, r.rule, r.detail) for r in jobs.validate(spark, [path], G.AGRONOMY_SPEC_5)["violations"].collect()}
    assert found == {(at, f"repeated_{what}", f"1:{first}") for at, first in ((4, 1), (6, 3)) for what in ("id", "input", "signature")} | {
        (5, "unknown_source_type", "bogus")}


def test_malformed_lines_fail_the_read(spark, tmp_path):
    path = write(tmp_path / "train.jsonl", G.AGRONOMY_SPEC)
    log = tmp_path / "log.jsonl"
    log.write_text('{"id": "1", "entry_type": "inference"}\n{"id": \n', encoding="utf-8")
    with open(path, "a", encoding="utf-8") as f:
        f.write("{not json\n")
    for df in (files.read_splits(spark, [path], G.AGRONOMY_SPEC), files.read_split(spark, path, G.AGRONOMY_SPEC), files.read_log(spark, str(log), G.AGRONOMY_SPEC)):
        with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
            df.collect()


def test_rows_without_text_are_told_and_counted(spark):
    rows = [("a", "corn", True), ("b", "  ", True), ("c", None, False)]
    corpus = spark.createDataFrame(rows, "id string, input string, flag boolean")
    assert sorted(r.id for r in jobs.rejected(corpus).collect()) == ["b", "c"]
    pred = corpus.filter("id = 'a'").select("id", "flag")
    frame = jobs.L.prediction_frame(corpus, pred, ["flag"])
    assert {(r.id, r.true_flag, r.pred_flag) for r in frame.collect()} == {("a", True, True), ("b", True, False), ("c", False, True)}
    cases = spark.createDataFrame([("x", True), ("y", True)], "name string, exp_flag boolean")
    checked = jobs.L.check_expectations(cases, spark.createDataFrame([("x", True)], "name string, flag boolean"), ["flag"], [])
    assert jobs.L.expectation_summary(checked).first() == (1, 2)


def test_vector_models_from_the_command_line(spark, tmp_path, monkeypatch):
    import labelmill.__main__ as command
    from labelmill.operators import heads as HD

    spec = G.AGRONOMY_SPEC
    data = [write(tmp_path / "train.jsonl", spec, 0, 8), write(tmp_path / "val.jsonl", spec, 100, 2), write(tmp_path / "test.jsonl", spec, 200, 2)]
    known = [(f"route_{start + i:06d}", [float(i % 6 == k) + 0.01 * (i % 5) for k in range(6)]) for start, n in ((0, 48), (100, 12), (200, 11)) for i in range(n)]
    spark.createDataFrame(known, "id string, embedding array<double>").write.parquet(str(tmp_path / "vectors"))
    monkeypatch.setattr(command, "clear_run", lambda _: True)
    main(["train-vectors", "--data", *data, "--embeddings", str(tmp_path / "vectors"), "--out", str(tmp_path / "out")])
    metrics = {s: spark.read.json(str(tmp_path / "out" / f"metrics_{s}")) for s in ("val", "test")}
    exact = {s: {(r.field, r.metric): r.value for r in m.collect()} for s, m in metrics.items()}
    assert min(v for (_, metric), v in exact["val"].items() if metric == "accuracy") == 1.0
    assert max(v for (_, metric), v in exact["test"].items() if metric == "accuracy") < 1.0, "the row without a vector counts as wrong"
    assert [r.id for r in spark.read.json(str(tmp_path / "out" / "without_vector")).collect()] == ["route_000211"]
    assert len(HD.load(spark, str(tmp_path / "out" / "model")).heads) == len(spec.binary) + len(spec.crops) + len(spec.topics) + 2
