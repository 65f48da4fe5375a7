"""Improving, auditing, reviewing and expectation jobs from the command line."""

import json

import pytest

from labelmill import config as G
from labelmill.__main__ import main
from labelmill.plans import jobs
from labelmill.sources import files
from test_feedback import EVENTS, write_log
from test_jobs import write

SPEC = G.AGRONOMY_SPEC


@pytest.fixture()
def run(spark, tmp_path, monkeypatch):
    import labelmill.__main__ as command

    monkeypatch.setattr(command, "clear_run", lambda _: True)
    return lambda job, *args: main([job, "--out", str(tmp_path / "out"), *args])


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    return str(path)


def test_improve_and_audit(spark, tmp_path, run):
    data = [write(tmp_path / "train.jsonl", SPEC, 0, 3), write(tmp_path / "val.jsonl", SPEC, 100)]
    vague = G.VAGUE_PHRASES_AUDIT[0]
    rows = [json.loads(x) for x in (tmp_path / "train.jsonl").read_text().splitlines()]
    for i in (4, 1, 9):
        rows[i]["input"] = f"{vague} number {i}"
    lines(tmp_path / "train.jsonl", rows)
    phrases = lines(tmp_path / "phrases.jsonl", [{"order_key": i, "phrase": p} for i, p in enumerate(["Corn YELLOW in the field", "rust on leaves of corn", "Rust on  leaves of corn", "beans after hail"])])
    labels = rows[0]["labels"]
    new = lambda c, i, text: {"category": c, "order_key": i, "candidate": text, "labels": labels, "difficulty": "hard", "notes": "n"}
    candidates = lines(tmp_path / "new.jsonl", [new("x", 2, "second of x"), new("x", 1, "beans after hail"), new("x", 3, "third of x"), new("y", 1, "Third of x"), new("y", 2, "only of y")])
    run("improve", "--data", *data, "--phrases", phrases, "--candidates", candidates, "--rewrites", "3", "--quotas", "x=2", "y=2", "--splits", "train=1", "val=3")
    out = lambda name: spark.read.json(str(tmp_path / "out" / name))
    after = {r.id: r for r in out("corpus").collect()}
    # The first two vague rows get the two new phrases, the third stays: there are no more.
    assert after[rows[1]["id"]].input == "rust on leaves of corn" and after[rows[4]["id"]].input == "beans after hail"
    assert after[rows[9]["id"]].input == f"{vague} number 9" and len(after) == 18 + 6 + 3
    added = sorted((r.id, r.split, r.input) for r in out("changes").filter("change = 'added'").collect())
    assert added == [("route_000106", "train", "second of x"), ("route_000107", "val", "third of x"), ("route_000108", "val", "only of y")]
    assert {r.category: r.missing for r in out("shortfall").collect()} == {"x": 0, "y": 1}
    assert after["route_000106"].labels.asDict() == labels | {k: v for k, v in after["route_000106"].labels.asDict().items() if k not in labels}
    diff = {r.metric: (r.before, r.after) for r in out("diff").collect()}
    assert diff["total"] == (24, 27) and diff["vague_rows"] == (3, 1)

    untouched = files.read_splits(spark, data, SPEC)
    assert {r["input"] for r in untouched.collect()} >= {f"{vague} number {i}" for i in (1, 4, 9)}
    with pytest.raises(ValueError, match="fewer"):
        jobs.improve(untouched, untouched, untouched, 1, [("x", 2)], [("train", 1)], SPEC)
    main(["audit", "--before", data[1], "--data", *data, "--out", str(tmp_path / "audit")])
    assert {r.metric: (r.before, r.after) for r in spark.read.json(str(tmp_path / "audit" / "diff")).collect()}["total"] == (6, 24)


def test_expectations(spark, tmp_path, run):
    model = str(tmp_path / "model")
    jobs.train(files.read_splits(spark, [write(tmp_path / "train.jsonl", SPEC, 0, 4)], SPEC), model, SPEC)
    cases = [{"name": "corn", "input": "corn yellow in the field", "expected": {"is_ag_related": True, "crops": ["corn"]}},
             {"name": "movie", "input": "movie tonight?", "expected": {"is_ag_related": False, "topics": []}}]
    run("expectations", "--data", lines(tmp_path / "good.jsonl", cases), "--model", model)
    wrong = [*cases, {"name": "soy", "input": "corn yellow in the field", "expected": {"crops": ["soybean"]}}, {"name": "blank", "input": " ", "expected": {"is_ag_related": False}}]
    with pytest.raises(ValueError, match="2 of 4 cases failed: blank, soy"):
        run("expectations", "--data", lines(tmp_path / "bad.jsonl", wrong), "--model", model)
    assert tuple(spark.read.json(str(tmp_path / "out" / "summary")).select("passed", "total").first()) == (2, 4)


def test_reviews_become_events(spark, tmp_path, run):
    log = tmp_path / "log"
    write_log(log, EVENTS, "part.jsonl")
    before = {r.interaction_id: r for r in jobs.fold_log(files.read_log(spark, str(log), SPEC))["interactions"].collect()}
    known = sorted(before)[0]
    entries = [{"interaction_id": known, "verdict": "incorrect", "notes": " why ", "raw_crops": "soybean, corn", "raw_urgency": "high"},
               {"interaction_id": "nobody", "verdict": "correct"}, {"interaction_id": known, "verdict": "maybe"}]
    run("reviews", "--data", str(log), "--entries", lines(tmp_path / "entries.jsonl", entries))
    out = lambda name: spark.read.json(str(tmp_path / "out" / name))
    assert sorted(r.reason for r in out("rejected").collect()) == ["unknown_interaction", "unknown_verdict"]
    event = out("events").collect()[0]
    assert (event.interaction_id, event.entry_type, event.review_notes) == (known, "review", "why")
    assert event.corrected_labels.crops == ["soybean", "corn"] and event.corrected_labels.urgency == "high"
    files.append_log(jobs.review(files.read_log(spark, str(log), SPEC), jobs.read_entries(spark, str(tmp_path / "entries.jsonl"), SPEC), SPEC)["events"], str(log / "more"))
    after = {r.interaction_id: r for r in jobs.fold_log(files.read_log(spark, str(log), SPEC))["interactions"].collect()}
    assert after[known].review_count == before[known].review_count + 1 and after[known].corrected_labels.crops == ["soybean", "corn"]
