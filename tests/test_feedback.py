import json
import random

import pytest
from pyspark.sql import functions as F

from labelmill.config import AGRONOMY, AGRONOMY_SPEC, ROUTER_THRESHOLDS
from labelmill.operators import corpus as C
from labelmill.operators import feedback as FB
from labelmill.operators import logodds as H
from labelmill.operators import route as R
from labelmill.sources import files
from labelmill.streaming import live

SPEC = AGRONOMY_SPEC


def labels(**changes):
    base = {"is_ag_related": True, "crops": ["corn"], "topics": ["soil"], **dict.fromkeys(SPEC.flags, False), "intent": "question", "urgency": "low"}
    return base | changes


def inference(i, at, text="t", **more):
    return {"id": i, "interaction_id": i, "entry_type": "inference", "timestamp": at, "input": text, "prediction": labels(),
            "confidence": {"is_ag_related": 0.9, "crops": {"corn": 0.8}}, "user_feedback": None, "corrected_labels": None} | more


def review(i, of, at, feedback, corrected=None, **more):
    return {"id": i, "interaction_id": of, "entry_type": "review", "timestamp": at, "input": None, "prediction": None, "confidence": None,
            "user_feedback": feedback, "corrected_labels": corrected, "review_notes": None} | more


FIXED = labels(crops=["soybean"])
EVENTS = [
    inference("a", "2026-01-01T00:00:02+00:00", "field looks bad"),
    inference("b", "2026-01-01T00:00:01+00:00", "movie"),
    review("r1", "a", "2026-01-01T00:00:05+00:00", "correct"),
    review("r2", "b", "2026-01-01T00:00:07+00:00", "correct"),
    review("r3", "b", "2026-01-01T00:00:06+00:00", "incorrect", FIXED),      # an earlier correction stays
    review("r4", "nobody", "2026-01-01T00:00:05+00:00", "correct"),          # orphan
    inference("c", "2026-01-01T00:00:03+00:00"),
    review("r5", "c", "2026-01-01T00:00:04+00:00", "incorrect"),             # unresolved
    inference("d", "2026-01-01T00:00:03+00:00"),
    review("r6", "d", "2026-01-01T00:00:04+00:00", "correct"),
    review("r7", "d", "2026-01-01T00:00:04+00:00", None),                    # same time, later id, null feedback
    inference("e", "2026-01-01T00:00:03+00:00", "old"),
    inference("e", "2026-01-01T00:00:03.5+00:00", "new", id="e2"),
    {"id": "f", "entry_type": "note", "timestamp": "2026-01-01T00:00:03+00:00"},
    inference("g", "2026-01-01T00:00:03+00:00", interaction_id=""),          # falls back to id
    review("r8", None, "2026-01-01T00:00:03+00:00", "correct", id="g"),
    inference("h", "2026-01-01T00:00:04+00:00", user_feedback="correct", corrected_labels=FIXED),
]


def write_log(folder, events, name="log.jsonl"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(e) for e in events) + "\n\n", encoding="utf-8")
    return str(folder)


@pytest.fixture()
def log(spark, tmp_path):
    return files.read_log(spark, write_log(tmp_path / "log", EVENTS), SPEC)


def test_fold(log):
    got = {r.interaction_id: r for r in FB.fold(log).collect()}
    assert sorted(got) == ["a", "b", "c", "d", "e", "g", "h"]
    state = {k: (r.user_feedback, r.review_count, r.corrected_labels and r.corrected_labels.crops) for k, r in got.items()}
    assert state == {"a": ("correct", 1, None), "b": ("correct", 2, ["soybean"]), "c": ("incorrect", 1, None), "d": (None, 2, None),
                     "e": (None, 0, None), "g": ("correct", 1, None), "h": ("correct", 0, ["soybean"])}
    assert got["e"].input == "new" and got["e"].id == "e2" and got["a"].confidence.crops == {"corn": 0.8}


def test_last_line_wins_over_time_where_lines_are_known(spark, log):
    rows = log.withColumn("line_no", F.when(F.col("id") == "e2", 1).otherwise(2))
    assert {r.interaction_id: r.input for r in FB.fold(rows, "line_no").collect()}["e"] == "old"


def test_golden_pair_to_feedback_rows(spark, tmp_path):
    events = [EVENTS[0], EVENTS[1], EVENTS[2], review("r2", "b", "2026-01-01T00:00:07+00:00", "correct")]
    folded = FB.fold(files.read_log(spark, write_log(tmp_path / "l", events), SPEC))
    rows = {r.id: r for r in FB.feedback_rows(folded).collect()}
    assert sorted(rows) == ["feedback_a", "feedback_b"]
    for name, text in (("a", "field looks bad"), ("b", "movie")):
        r = rows[f"feedback_{name}"]
        assert r.input == text and r.labels.asDict() == labels()
        assert r.meta.asDict() == {"source_type": "real_world_feedback", "original_interaction_id": name, "review_count": 1, "feedback": "correct"}


def test_resolution_queue_and_reviews(log):
    folded = FB.fold(log)
    assert sorted(r.id for r in FB.feedback_rows(folded).collect()) == ["feedback_a", "feedback_b", "feedback_g", "feedback_h"]
    assert sorted(r.interaction_id for r in FB.review_queue(folded).collect()) == ["d", "e"]
    assert FB.review_queue(folded, everything=True).count() == 7
    for hot_rows in (1_000_000, 1):
        assert sorted(r.id for r in FB.reviews_of(log, folded, hot_rows).collect()) == ["g", "r1", "r2", "r3", "r5", "r6", "r7"]


def test_one_interaction_with_most_events(spark, tmp_path):
    rng = random.Random(5)
    events = [inference("hot", "t00000")] + [review(f"r{i:05d}", "hot", f"t{rng.randint(1, 300):05d}", rng.choice(["correct", "incorrect"]),
              FIXED if rng.random() < 0.1 else None) for i in range(1500)] + [inference(f"i{i}", "t1") for i in range(700)]
    rng.shuffle(events)
    row = FB.fold(files.read_log(spark, write_log(tmp_path / "l", events), SPEC)).filter("interaction_id = 'hot'").first()
    last = max((e for e in events if e["entry_type"] == "review"), key=lambda e: (e["timestamp"], e["id"]))
    assert row.review_count == 1500 and row.user_feedback == last["user_feedback"] and row.corrected_labels.crops == ["soybean"]


def test_missing_log_is_empty(spark, tmp_path):
    assert FB.fold(files.read_log(spark, str(tmp_path / "absent"), SPEC)).count() == 0


def test_stream_fold_equals_batch_fold_over_several_batches(spark, tmp_path):
    folder = tmp_path / "log"
    for i in range(0, len(EVENTS), 5):
        write_log(folder, EVENTS[i:i + 5], f"part{i:03d}.jsonl")
        live.fold_stream(live.read_log_stream(spark, str(folder), SPEC), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = FB.fold(files.read_log(spark, str(folder), SPEC)).orderBy("interaction_id").collect()
    stream = live.read_fold(spark, str(tmp_path / "out")).orderBy("interaction_id").collect()
    assert stream == batch and len(batch) == 7


def test_bad_log_lines_take_nothing_with_them(spark, tmp_path):
    folder = tmp_path / "log"
    write_log(folder, EVENTS, "good.jsonl")
    bad = ['{"id": "cut off', "[1]", '{"id": "x", "id": "y"}', '{"id": "nothing of an event", "prediction": {}}', "5"]
    (folder / "bad.jsonl").write_text("\n".join([bad[0], *map(json.dumps, EVENTS[:1]), "", *bad[1:]]), encoding="utf-8")
    want = ["bad_json", "not_an_event", "not_an_object", "not_an_object", "repeated_key"]
    events, rejected = files.read_log_lines(spark, str(folder), SPEC)
    assert events.count() == len(EVENTS) + 1 and events.schema == files.read_log(spark, str(tmp_path / "absent"), SPEC).schema
    assert sorted(r.reason for r in rejected.collect()) == want
    assert [(r.file, r.line_no) for r in rejected.filter("reason = 'bad_json'").collect()] == [("bad.jsonl", 1)]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        files.read_log(spark, str(folder), SPEC).collect()
    good, other = str(tmp_path / "events"), str(tmp_path / "rejected")
    for _ in range(2):
        live.quarantine_log(spark, str(folder), SPEC, good, other, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(good).count() == len(EVENTS) + 1
    assert sorted((r.reason, r.value) for r in spark.read.parquet(other).collect()) == sorted((r.reason, r.value) for r in rejected.collect())


FIELDS = ("is_ag_related", *SPEC.flags, "crops", "topics", "intent", "urgency")


def test_failure_mining(spark, tmp_path):
    wrong = labels(crops=["soybean"], intent="planning")
    events = []
    for i, fixed in enumerate([wrong, wrong, labels(crops=["soybean"]), labels(topics=["soil"]), None]):
        events += [inference(f"q{i}", f"t{i}"), review(f"r{i}", f"q{i}", "t9", "incorrect" if fixed else "correct", fixed)]
    resolved = FB.add_resolved(FB.fold(files.read_log(spark, write_log(tmp_path / "l", events), SPEC)))
    errors = FB.field_errors(resolved, FIELDS, ["crops", "topics"], keep=["interaction_id", "timestamp"])
    assert sorted((r.interaction_id, r.field, r.pred_value, r.final_value) for r in errors.collect()) == [
        ("q0", "crops", "[corn]", "[soybean]"), ("q0", "intent", "question", "planning"), ("q1", "crops", "[corn]", "[soybean]"),
        ("q1", "intent", "question", "planning"), ("q2", "crops", "[corn]", "[soybean]")]
    marked = FB.add_mismatches(resolved, FIELDS, ["crops", "topics"])
    assert [tuple(r) for r in FB.failure_patterns(marked, F.col("timestamp")).collect()] == [("crops, intent", 2, "t0"), ("crops", 1, "t2")]
    assert [tuple(r) for r in FB.failure_patterns(marked, F.col("timestamp"), 1).collect()] == [("crops, intent", 2, "t0")]
    assert tuple(FB.feedback_summary(marked).first()) == (5, 3)
    top = FB.field_confusions(errors, F.col("timestamp")).filter("field = 'crops'").first()
    assert (top.n, top.first_seen, top.position) == (3, "t0", 1)


def test_reviewer_entries_become_review_events(spark):
    raw = {f"raw_{n}": "" for n in C.label_names(SPEC)}
    raw |= {"raw_needs_rag": " yes ", "raw_crops": "corn, ,soybean", "raw_intent": " planning "}
    row = {"interaction_id": "a", "prediction": labels(), "verdict": "incorrect", "notes": "  ", **raw}
    ok = row | {"interaction_id": "b", "verdict": "correct", "notes": "fine"}
    schema = f"interaction_id string, prediction struct<{C.labels_schema(SPEC).simpleString()[7:-1]}>, verdict string, notes string, " + \
        ", ".join(f"{k} string" for k in raw)
    names = ["interaction_id", "prediction", "verdict", "notes", *raw]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in (row, ok)], schema)
    a, b = FB.review_events(df, SPEC, F.concat(F.lit("rev-"), "interaction_id"), F.lit("t")).orderBy("interaction_id").collect()
    assert a.corrected_labels.asDict() == labels(needs_rag=True, crops=["corn", "soybean"], intent="planning") and a.review_notes is None
    assert b.corrected_labels is None and b.user_feedback == "correct" and b.review_notes == "fine" and b.id == "rev-b"


def test_route_log_review_fold_loop(spark, tmp_path):
    """Score, append, review, append, fold: the whole loop through files."""
    heads = [(i, h.field, h.label, h.label_pos, -20000, h.threshold) for i, h in enumerate(H.heads_of(SPEC, ROUTER_THRESHOLDS))]
    scorer = H.compile_model(H.TokenModel(spark.createDataFrame(heads, H.HEADS_SCHEMA), spark.createDataFrame([], H.WEIGHTS_SCHEMA)))
    path = str(tmp_path / "log")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "q.json").write_text('{"id":"1","input":" corn yellow "}\n{"id":"2","input":"  "}\n{"id":"3","input":"movie"}\n', encoding="utf-8")
    queries = spark.readStream.schema("id string, input string").json(str(tmp_path / "in"))
    live.route_and_log(queries, scorer, AGRONOMY, path, str(tmp_path / "ck")).awaitTermination()
    events = files.read_log(spark, path, SPEC)
    rows = {r.input: r for r in events.collect()}
    assert sorted(rows) == ["corn yellow", "movie"] and rows["corn yellow"].prediction.needs_rag is True
    assert rows["corn yellow"].confidence.crops["corn"] == 0.82 and rows["movie"].prediction.crops == []
    reviews = events.filter("input = 'movie'").select(
        F.lit("r").alias("id"), "interaction_id", F.lit("review").alias("entry_type"), F.lit("9999").alias("timestamp"), F.lit("correct").alias("user_feedback"))
    files.append_log(reviews, path)
    folded = FB.fold(files.read_log(spark, path, SPEC))
    assert [(r.input, r.meta.review_count) for r in FB.feedback_rows(folded).collect()] == [("movie", 1)]
    batch = R.to_events(R.route(spark.createDataFrame([("1", "corn")], "id string, input string"), scorer, AGRONOMY), AGRONOMY).first()
    assert len(batch.id) == 32 and batch.id == batch.interaction_id and batch.timestamp.endswith("+00:00")
