"""Log fold and feedback mining.

Folding uses only aggregates that combine before the shuffle, so one very busy
interaction costs one partial row per task.  Reviews stay rows of their own
table; they are never gathered into one value per interaction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.config import LabelSpec
from labelmill.functions import text as X
from labelmill.operators.corpus import label_names
from labelmill.operators.scale import HOT_ROWS, first_n, join_by_key, top_k


def interaction_key() -> Column:
    """``interaction_id``, or ``id`` where that is null or empty."""
    return F.coalesce(F.nullif(F.col("interaction_id"), F.lit("")), F.col("id"))


def fold(events: DataFrame, line: str | None = None) -> DataFrame:
    """Fold inference and review events into one row per interaction.

    The last inference wins (by ``line`` where given, else by timestamp and id).
    Final feedback is the last review's, even when null; the correction is the
    last one that is not null.  Reviews without an inference are dropped.
    """
    return interactions(fold_parts(events, line))


def fold_parts(events: DataFrame, line: str | None = None) -> DataFrame:
    """The fold's aggregates per interaction; batch and streaming frames alike."""
    position = F.struct(line) if line else F.struct("timestamp", "id")
    review_at = F.struct(F.coalesce("timestamp", F.lit("")), F.coalesce("id", F.lit("")))
    is_inference = F.col("entry_type") == "inference"
    is_review = F.col("entry_type") == "review"
    inference = F.struct("id", "timestamp", "input", "prediction", "confidence", "user_feedback", "corrected_labels")
    review = F.struct("user_feedback")
    corrected = is_review & F.col("corrected_labels").isNotNull()
    return (
        events.filter(is_inference | is_review).withColumn("interaction", interaction_key())
        .groupBy("interaction").agg(
            F.max_by(F.when(is_inference, inference), F.when(is_inference, position)).alias("inf"),
            F.max_by(F.when(is_review, review), F.when(is_review, review_at)).alias("last_review"),
            F.max_by(F.when(corrected, F.col("corrected_labels")), F.when(corrected, review_at)).alias("correction"),
            F.count_if(is_review).alias("review_count"),
            F.count_if(is_inference).alias("inferences"),
        )
    )


def interactions(folded: DataFrame) -> DataFrame:
    """Final interaction columns from the aggregated parts."""
    return folded.filter(F.col("inferences") > 0).select(
        F.col("inf.id").alias("id"), F.col("interaction").alias("interaction_id"),
        F.col("inf.timestamp").alias("timestamp"), F.col("inf.input").alias("input"),
        F.col("inf.prediction").alias("prediction"), F.col("inf.confidence").alias("confidence"),
        F.when(F.col("review_count") > 0, F.col("last_review.user_feedback"))
        .otherwise(F.col("inf.user_feedback")).alias("user_feedback"),
        F.coalesce("correction", "inf.corrected_labels").alias("corrected_labels"),
        F.col("review_count").cast("int").alias("review_count"))


def reviews_of(events: DataFrame, folded: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Review events that belong to a folded interaction, one row each; their
    order is (timestamp, id)."""
    reviews = events.filter(F.col("entry_type") == "review").withColumn("interaction_id", interaction_key())
    known = folded.filter(F.col("review_count") > 0).select("interaction_id", F.col("review_count").alias("__reviews"))
    return join_by_key(reviews, known, "interaction_id", "__reviews", hot_rows).drop("__reviews")


def add_resolved(folded: DataFrame) -> DataFrame:
    """Resolved labels: the correction, else the prediction if judged correct.

    A correction that names no label is none, so the feedback decides; a later
    ``correct`` review does not clear an earlier correction."""
    labels = folded.schema["corrected_labels"].dataType.fieldNames()
    given = F.greatest(*[F.col(f"corrected_labels.{name}").isNotNull() for name in labels], F.lit(False))
    return folded.withColumn("final", F.coalesce(
        F.when(given, F.col("corrected_labels")), F.when(F.col("user_feedback") == "correct", F.col("prediction"))))


def feedback_rows(folded: DataFrame, source_type: str = "real_world_feedback") -> DataFrame:
    """Corpus rows from resolved interactions."""
    meta = F.struct(
        F.lit(source_type).alias("source_type"), F.col("interaction_id").alias("original_interaction_id"),
        "review_count", F.col("user_feedback").alias("feedback"))
    return add_resolved(folded).filter(F.col("final").isNotNull()).select(
        F.concat(F.lit("feedback_"), F.col("interaction_id")).alias("id"), "input",
        F.col("final").alias("labels"), meta.alias("meta"))


def review_queue(folded: DataFrame, everything: bool = False) -> DataFrame:
    """Interactions without feedback, or all of them."""
    return folded if everything else folded.filter(F.col("user_feedback").isNull())


def review_events(reviews: DataFrame, spec: LabelSpec, event_id: Column | None = None, at: Column | None = None) -> DataFrame:
    """Review events from a table of reviewer entries joined with predictions.

    ``reviews`` has interaction_id, prediction, verdict (``correct`` or
    ``incorrect``), raw text per label field (``raw_<field>``) and notes; blank
    entries keep the predicted value.
    """
    fixed = []
    for name in label_names(spec):
        raw, current = F.col(f"raw_{name}"), F.col(f"prediction.{name}")
        parse = X.parse_list if name in spec.sets else X.parse_text if name in spec.classes else X.parse_bool
        fixed.append(parse(raw, current).alias(name))
    new_id = F.replace(F.uuid(), F.lit("-"), F.lit("")) if event_id is None else event_id
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00") if at is None else at
    return reviews.select(
        new_id.alias("id"), "interaction_id", F.lit("review").alias("entry_type"), stamp.alias("timestamp"),
        F.col("verdict").alias("user_feedback"),
        F.when(F.col("verdict") == "incorrect", F.struct(*fixed)).alias("corrected_labels"),
        F.nullif(X.strip(F.col("notes")), F.lit("")).alias("review_notes"))


# --- failure mining ------------------------------------------------------------

def field_errors(resolved: DataFrame, fields: Sequence[str], lists: Sequence[str] = (), predicted: str = "prediction",
                 final: str = "final", keep: Sequence[str] = ("interaction_id",)) -> DataFrame:
    """One row per field where prediction and final label differ.  Lists are
    compared sorted, absent values as null."""
    cells = []
    for name in fields:
        p, t = F.col(f"{predicted}.{name}"), F.col(f"{final}.{name}")
        wrong = X.lists_differ(p, t) if name in lists else ~p.eqNullSafe(t)
        show = (lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))) if name in lists else (lambda c: c.cast("string"))
        cells.append(F.when(wrong, F.struct(
            F.lit(name).alias("field"), show(p).alias("pred_value"), show(t).alias("final_value"))))
    rows = resolved.filter(F.col(final).isNotNull())
    return rows.select(*keep, F.inline(F.array_compact(F.array(*cells))))


def add_mismatches(resolved: DataFrame, fields: Sequence[str], lists: Sequence[str] = (), predicted: str = "prediction",
                   final: str = "final") -> DataFrame:
    """Reviewed rows with their array of mismatching field names."""
    cells = []
    for name in fields:
        p, t = F.col(f"{predicted}.{name}"), F.col(f"{final}.{name}")
        wrong = X.lists_differ(p, t) if name in lists else ~p.eqNullSafe(t)
        cells.append(F.when(wrong, F.lit(name)))
    return resolved.filter(F.col(final).isNotNull()).withColumn("mismatches", F.array_compact(F.array(*cells)))


def failure_patterns(marked: DataFrame, first_seen: Column, k: int = 10) -> DataFrame:
    """Most common sets of wrong fields; ties go to the pattern seen first."""
    pattern = F.array_join(F.array_sort("mismatches"), ", ")
    rows = marked.select(pattern.alias("pattern"), first_seen.alias("seen"), F.size("mismatches").alias("size"))
    counted = rows.groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), F.min("seen").alias("first_seen"), F.max("size").alias("size"))
    # The filter reads an aggregate, so that it stays above the grouping and
    # the comparisons are not evaluated twice.
    wrong = counted.filter(F.col("size") > 0).drop("size")
    return wrong.orderBy(F.desc("n"), "first_seen").limit(k)


def field_confusions(errors: DataFrame, first_seen: Column, k: int = 5) -> DataFrame:
    """Most common (predicted, final) pairs per field."""
    counted = errors.groupBy("field", "pred_value", "final_value").agg(
        F.count(F.lit(1)).alias("n"), F.min(first_seen).alias("first_seen"))
    return top_k(counted, ["field"], [F.desc("n"), F.col("first_seen")], k, "position")


def field_error_counts(errors: DataFrame) -> DataFrame:
    """Errors per field, most frequent first."""
    return errors.groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field")


def failure_examples(marked: DataFrame, order: Sequence[str], k: int = 10) -> DataFrame:
    """First ``k`` reviewed rows with errors, in the given total order."""
    return first_n(marked.filter(F.size("mismatches") > 0), [F.col(c) for c in order], k)


def feedback_summary(marked: DataFrame) -> DataFrame:
    """Reviewed rows and how many of them have errors."""
    return marked.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.size("mismatches") > 0).alias("with_errors"))
