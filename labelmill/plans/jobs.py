"""Whole jobs over corpus and log files, as dictionaries of result tables.

Each job composes the operators; nothing is written or raised here except where
a name says so.  ``python -m labelmill`` runs them from the command line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill import config as G
from labelmill.functions import text as X
from labelmill.operators import evaluate as L
from labelmill.operators import feedback as FB
from labelmill.operators import heads as HD
from labelmill.operators import logodds as H
from labelmill.operators import profile as P
from labelmill.operators import route as R
from labelmill.operators import validate as V
from labelmill.operators import vectors as K
from labelmill.operators import synth as M
from labelmill.operators.corpus import label_names, labels_schema, order_columns
from labelmill.operators.lexicon import rule_predict
from labelmill.operators.scale import cut_lineage
from labelmill.sources import files

Tables = dict[str, DataFrame]


def _marks(corpus: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """Label fields and text marks without the text, read once."""
    return cut_lineage(P.text_marks(corpus, phrases).drop("notes"))


def _first(corpus: DataFrame) -> list[str]:
    return [c for c in ("split_pos", "line_no", "id") if c in corpus.columns]


def validate(spark: SparkSession, paths: Sequence[str], spec: G.LabelSpec = G.AGRONOMY_SPEC_5, schema: dict | None = None,
             expected: Sequence[tuple[str, int]] = G.EXPECTED_SPLITS, combos: Sequence[tuple] = G.EDGE_COMBOS) -> Tables:
    """Raw-line and row violations, split sizes, statistics, gate and coverage.

    Rows and raw lines are named by split or file and line number.  Lines that
    are no JSON object are line violations; all others are validated.  Keys and
    types come from ``spec``, and from ``schema`` as well where one is given.
    """
    lines = files.read_numbered_lines(spark, list(paths))
    readable, _ = V.split_lines(lines)
    corpus = files.parse_splits(readable, spec)
    marks = _marks(corpus, G.VAGUE_PHRASES)
    stats = P.corpus_stats(marks, spec.domain, spec.flags[0], G.VAGUE_PHRASES)
    out = {
        "violations": V.validate_corpus(corpus, spec),
        "splits": P.split_expectation(marks, expected),
        "stats": stats,
        "checks": P.distribution_gate(stats, G.GATE_BANDS, P.combo_minimums(marks, spec.flags, combos)),
        "coverage": P.label_coverage(marks, "topics", spec.topics, stats),
    }
    found = V.validate_lines(lines, V.spec_schema(spec), ["file", "line_no"])
    if schema is not None:
        found = found.unionByName(V.validate_lines(lines, schema, ["file", "line_no"])).distinct()
    out["line_violations"] = found
    return out


def gate(tables: Tables) -> None:
    """Raise on the first kind of failure among the tables of ``validate``."""
    for name in ("line_violations", "violations"):
        if name in tables:
            V.raise_on_violation(tables[name])
    wrong = [r["split"] for r in tables["splits"].filter(~F.col("ok")).collect()]
    if wrong:
        raise ValueError("split sizes differ: " + ", ".join(sorted(wrong)))
    P.raise_on_fail(tables["checks"])


def report(corpus: DataFrame, spec: G.LabelSpec = G.AGRONOMY_SPEC_5, combos: Sequence[tuple] = G.EDGE_COMBOS, samples: int = 3) -> Tables:
    """Histograms with shares, combinations, samples, duplicates and warnings."""
    marks = _marks(corpus, G.VAGUE_PHRASES)
    stats = P.corpus_stats(marks, spec.domain, spec.flags[0], G.VAGUE_PHRASES)
    classes = {"outside": ~F.col(spec.domain), **P.combo_classes(spec.flags, combos, spec.domain),
               "hard": F.col(spec.domain) & (F.col("difficulty") == "hard")}
    scalars = [c for c in ("split", "intent", "urgency", "difficulty") if c in marks.columns]
    named = P.combo_minimums(marks, spec.flags, combos)
    return {
        "stats": stats,
        "scalars": P.with_share(P.histogram(marks, scalars, flags=spec.flags), stats, "total"),
        "lists": P.with_share(P.histogram(marks, arrays=["crops", "topics"]), stats, "domain_total"),
        "combos": named,
        "samples": P.class_samples(corpus, classes, order_columns(corpus), samples).select("class", "pick", "id", "input"),
        "duplicates": P.duplicate_groups(marks, position=_first(marks)),
        "warnings": P.distribution_gate(stats, G.REPORT_BANDS, named, "warn").filter(F.col("severity") == "warn"),
        "light_topics": P.label_coverage(marks, "topics", spec.topics, stats, zero=False).filter("low"),
    }


def audit(before: DataFrame, after: DataFrame, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> Tables:
    """Findings of two snapshots and their statistics side by side."""
    out: Tables = {}
    both = before.withColumn("snapshot", F.lit("before")).unionByName(after.withColumn("snapshot", F.lit("after")))
    marks = _marks(both, G.VAGUE_PHRASES_AUDIT)
    args = (spec.domain, spec.flags[0], G.VAGUE_PHRASES_AUDIT)
    for name in ("before", "after"):
        rows = marks.filter(F.col("snapshot") == name)
        groups = P.duplicate_groups(rows, position=_first(rows)).agg(F.count(F.lit(1)).alias("duplicate_groups"))
        out[f"findings_{name}"] = P.audit_findings(
            P.corpus_stats(rows, *args), G.AUDIT_BANDS, P.combo_minimums(rows, spec.flags, G.AUDIT_COMBOS),
            P.histogram(rows, arrays=["topics"]), groups)
    metrics = ("total", "domain_total", "short_rows", "vague_rows", "multi_topic_rows", "hard_rows", "lead_flag_rows")
    out["diff"] = P.audit_diff(P.corpus_stats(marks, *args, group="snapshot"), "snapshot", "before", "after", metrics)
    return out


def train(corpus: DataFrame, path: str, spec: G.LabelSpec = G.AGRONOMY_SPEC, thresholds: G.Thresholds = G.ROUTER_THRESHOLDS) -> None:
    """Fit the token model on all given rows and store it."""
    H.save_model(H.fit(corpus, H.heads_of(spec, thresholds)), path)


def fields_of(spec: G.LabelSpec) -> L.EvalFields:
    return L.EvalFields(spec.binary, tuple(spec.classes), spec.sets)


def frame_of(truth: DataFrame, pred: DataFrame, spec: G.LabelSpec, split: str | None = None) -> DataFrame:
    names = [*spec.binary, *spec.sets, *spec.classes]
    return L.prediction_frame(truth, pred, names, split=split)


def evaluate(frame: DataFrame, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> Tables:
    """Metrics, and confusion counts of every binary and class field."""
    out = {"metrics": L.evaluate(frame, fields_of(spec))}
    for name in spec.binary:
        typed = frame.withColumns({f"{side}_{name}": F.col(f"{side}_{name}").cast("int") for side in ("true", "pred")})
        out[f"confusion_{name}"] = L.confusion(typed, name, ("0", "1"))
    out |= {f"confusion_{name}": L.confusion(frame, name, space) for name, space in spec.classes.items()}
    return out


def compare_with_rules(corpus: DataFrame, pred: DataFrame, rules: G.RuleConfig = G.AGRONOMY_EVAL) -> Tables:
    """Metrics of given predictions and of the rules, and the winner per field."""
    spec = rules.spec
    by_rules = rule_predict(corpus.select("id", "input"), rules).drop("input")
    model = L.evaluate(frame_of(corpus, pred, spec), fields_of(spec))
    ruled = L.evaluate(frame_of(corpus, by_rules, spec), fields_of(spec))
    return {"model_metrics": model, "rule_metrics": ruled, "comparison": L.compare_metrics(model, ruled, list(spec.sets))}


def analyse_routing(frame: DataFrame, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> Tables:
    """Over- and under-triggering: rates, breakdown and worst groups."""
    decided = L.add_decision(frame, spec.flags)
    groups = {"topic": X.default_list(F.col("true_topics")), "crop": X.default_list(F.col("true_crops")), "intent": F.array("true_intent")}
    rows = L.decision_breakdown(decided, groups)
    return {"rates": L.decision_rates(decided), "breakdown": rows, "worst": L.worst_groups(rows)}


def analyse_errors(frame: DataFrame, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> Tables:
    """Error records, counts, hotspots and first examples."""
    named = frame.withColumns({"topic": X.join_list(F.col("true_topics")), "crop": X.join_list(F.col("true_crops")),
                               "intent": F.col("true_intent")})
    errors = L.error_records(named, fields_of(spec), ["id", "input", "topic", "crop", "intent"])
    counts = L.error_counts(errors, {c: F.col(c) for c in ("label", "topic", "crop", "intent")})
    limits = {"all": 50, "false_positive": 10, "false_negative": 10}
    return {"errors": errors, "counts": counts, "hotspots": L.hotspots(counts),
            "examples": L.error_examples(errors, [F.col("id"), F.col("label_pos")], limits)}


def train_vectors(corpus: DataFrame, embeddings: DataFrame, path: str, spec: G.LabelSpec = G.AGRONOMY_SPEC, exclusive: Sequence[str] = ("crops",)) -> Tables:
    """Fit all heads on the train split, store them, and evaluate what is read back on the other splits.

    ``embeddings`` are (id, embedding).  Rows without a vector are listed and
    count as wrong in the metrics of their split, null fields of the train
    split as no label.
    """
    spark = corpus.sparkSession
    vectors = K.embed(embeddings.select("id", "embedding").dropDuplicates(["id"]))
    rows = cut_lineage(corpus.join(vectors.drop("embedding"), "id", "left"))
    with_vector = rows.filter(F.col("vector").isNotNull())
    HD.save(HD.fit(with_vector.filter("split = 'train'"), spec.binary, spec.sets, spec.classes), spark, path)
    pred = cut_lineage(HD.predict(with_vector, HD.load(spark, path), exclusive).select("id", *[f"pred_{f}" for f in (*spec.binary, *spec.sets, *spec.classes)]))
    named = pred.withColumnsRenamed({c: c.removeprefix("pred_") for c in pred.columns})
    out = {"predictions": pred, "without_vector": rows.filter(F.col("vector").isNull()).select("split", "id", "input")}
    for split in ("val", "test"):
        out[f"metrics_{split}"] = L.evaluate(frame_of(corpus.filter(F.col("split") == split), named, spec, split), fields_of(spec))
    return out


def fold_log(events: DataFrame) -> Tables:
    """Interactions, feedback rows and the review queue of a log."""
    folded = FB.fold(events)
    return {"interactions": folded, "feedback": FB.feedback_rows(folded), "queue": FB.review_queue(folded)}


def mine_failures(events: DataFrame, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> Tables:
    """What reviewers corrected: summary, fields, patterns, confusions, examples."""
    resolved = FB.add_resolved(FB.fold(events))
    fields, lists = [*spec.binary, *spec.sets, *spec.classes], list(spec.sets)
    errors = FB.field_errors(resolved, fields, lists, keep=["interaction_id", "timestamp"])
    marked = FB.add_mismatches(resolved, fields, lists)
    seen = F.struct("timestamp", "interaction_id")
    return {
        "summary": FB.feedback_summary(marked), "fields": FB.field_error_counts(errors),
        "patterns": FB.failure_patterns(marked, seen), "confusions": FB.field_confusions(errors, seen),
        "examples": FB.failure_examples(marked, ["timestamp", "interaction_id"]),
    }


def predict(corpus: DataFrame, model: H.TokenModel, rules: G.RuleConfig = G.AGRONOMY) -> DataFrame:
    """Routed predictions of a corpus, by id.  Rows without text have none: see :func:`rejected`."""
    texts, _ = R.split_blank(corpus.select("id", "input"))
    return R.route(texts, model, rules)


def rejected(corpus: DataFrame) -> DataFrame:
    """Rows that cannot be routed because they have no text."""
    names = [c for c in ("split", "line_no", "id", "input") if c in corpus.columns]
    return R.split_blank(corpus.select(*names))[1]


def expect(cases: DataFrame, model: H.TokenModel, spec: G.LabelSpec = G.AGRONOMY_SPEC, rules: G.RuleConfig = G.AGRONOMY) -> Tables:
    """Named cases routed and held against what they expect.

    ``cases`` are (name, input, expected); null fields of ``expected`` are not
    checked, lists pass where they are contained.  Names have to be unique.  A
    case without text has no prediction and fails all that it checks.
    """
    wanted = cases.select("name", *[F.col(f"expected.{n}").alias(f"exp_{n}") for n in label_names(spec)])
    pred = predict(cases.select(F.col("name").alias("id"), "input"), model, rules).withColumnRenamed("id", "name")
    checked = cut_lineage(L.check_expectations(wanted, pred.select("name", *label_names(spec)), [*spec.binary, *spec.classes], list(spec.sets)))
    return {"checked": checked, "failed": checked.filter(~F.col("all_passed")), "summary": L.expectation_summary(checked)}


def gate_expectations(tables: Tables) -> None:
    """Raise where a case of :func:`expect` failed."""
    passed, total = tables["summary"].first()
    if passed != total:
        names = [r["name"] for r in tables["failed"].select("name").orderBy("name").limit(10).collect()]
        raise ValueError(f"{total - passed} of {total} cases failed: {', '.join(names)}")


def review(events: DataFrame, entries: DataFrame, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> Tables:
    """Reviewer entries as events for the log, those that cannot become one with a reason, and the reviews so far.

    ``entries`` are (interaction_id, verdict, notes, raw_<field>).  Verdicts are
    ``correct`` or ``incorrect``.  The interaction has to have an inference.
    """
    folded = cut_lineage(FB.fold(events))
    judged = entries.join(folded.select("interaction_id", "prediction", F.lit(True).alias("__known")), "interaction_id", "left").withColumn(
        "reason", F.when(F.col("__known").isNull(), "unknown_interaction").when(~F.coalesce(F.col("verdict").isin("correct", "incorrect"), F.lit(False)), "unknown_verdict"))
    return {
        "events": FB.review_events(judged.filter(F.col("reason").isNull()), spec),
        "rejected": judged.filter(F.col("reason").isNotNull()).drop("prediction", "__known"),
        "reviews": FB.reviews_of(events, folded),
    }


def improve(corpus: DataFrame, phrases: DataFrame, candidates: DataFrame, rewrites: int, quotas: Sequence[tuple[str, int]],
            splits: Sequence[tuple[str, int]], spec: G.LabelSpec = G.AGRONOMY_SPEC) -> Tables:
    """Reword vague rows, add new rows by quota, and compare the corpus before and after.

    The first ``rewrites`` vague rows get the first ``phrases`` (order_key,
    phrase) that are new to the corpus; with fewer phrases, the rest stay.
    ``candidates`` are (category, order_key, candidate, labels, difficulty,
    notes), taken in order up to ``quotas`` and dealt to ``splits`` in turn; what
    is lacking is in ``shortfall``.  Ids have to be unique (see
    :func:`validate`) and go on after the largest.
    """
    if sum(n for _, n in splits) < sum(n for _, n in quotas):
        raise ValueError("splits take fewer rows than the quotas give")
    first = _first(corpus)
    marked = P.text_shape(corpus.select(*first, "input"), G.VAGUE_PHRASES_AUDIT)
    picks = M.pick_rows(marked, F.coalesce("is_vague", F.lit(False)), "id", first, rewrites)
    pool = M.phrase_pool(phrases, corpus, ["order_key", "phrase"], rewrites)
    reworded = cut_lineage(M.ranked_rewrite(corpus, picks, pool, "id", "input"))
    order = ["order_key", "candidate"]
    named = [(candidates.filter(F.col("category") == name).drop("category"), name, n) for name, n in quotas]
    accepted = cut_lineage(M.fill_quotas(named, reworded, order))
    placed = M.allocate_splits(M.assign_ids(accepted, corpus, [F.col(c) for c in ("category_pos", *order)]), splits)
    split_pos = F.array_position(F.array(*[F.lit(name) for name, _ in splits]), F.col("split")) - 1
    last = corpus.select(F.coalesce(F.max("line_no"), F.lit(0)).alias("n")).scalar()
    added = placed.select(
        "split", split_pos.cast(corpus.schema["split_pos"].dataType).alias("split_pos"), (last + F.col("add_pos")).alias("line_no"), "id",
        F.col("candidate").alias("input"), *[F.col(f"labels.{n}").alias(n) for n in label_names(spec)],
        F.lit("synthetic").alias("source_type"), "difficulty", "notes")
    improved = cut_lineage(reworded.drop("rewritten").unionByName(added.select(*corpus.columns)))
    changes = reworded.filter("rewritten").select("split", "id", "input", F.lit("reworded").alias("change")).unionByName(
        added.select("split", "id", "input", F.lit("added").alias("change")))
    return {"corpus": improved, "changes": changes, "shortfall": M.quota_shortfall(accepted, quotas),
            "violations": V.validate_corpus(improved, spec), **audit(corpus, improved, spec)}


def read_cases(spark: SparkSession, path: str, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> DataFrame:
    return files.read_jsonl(spark, path, f"name string, input string, expected {labels_schema(spec).simpleString()}")


def read_entries(spark: SparkSession, path: str, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> DataFrame:
    raw = ", ".join(f"raw_{name} string" for name in label_names(spec))
    return files.read_jsonl(spark, path, f"interaction_id string, verdict string, notes string, {raw}")


def read_candidates(spark: SparkSession, path: str, spec: G.LabelSpec = G.AGRONOMY_SPEC) -> DataFrame:
    labels = labels_schema(spec).simpleString()
    return files.read_jsonl(spark, path, f"category string, order_key bigint, candidate string, labels {labels}, difficulty string, notes string")
