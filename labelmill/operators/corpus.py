"""Corpus schemas and the flat corpus frame that the other operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.config import LabelSpec


def labels_schema(spec: LabelSpec) -> T.StructType:
    strings = T.ArrayType(T.StringType())
    fields = [T.StructField(spec.domain, T.BooleanType())]
    fields += [T.StructField("crops", strings), T.StructField("topics", strings)]
    fields += [T.StructField(flag, T.BooleanType()) for flag in spec.flags]
    fields += [T.StructField("intent", T.StringType()), T.StructField("urgency", T.StringType())]
    return T.StructType(fields)


def corpus_schema(spec: LabelSpec) -> T.StructType:
    meta = T.StructType.fromDDL("source_type string, difficulty string, notes string")
    return T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("labels", labels_schema(spec)),
        T.StructField("meta", meta),
    ])


def feedback_schema(spec: LabelSpec) -> T.StructType:
    meta = T.StructType.fromDDL(
        "source_type string, original_interaction_id string, review_count int, feedback string"
    )
    return T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("labels", labels_schema(spec)),
        T.StructField("meta", meta),
    ])


def confidence_schema(spec: LabelSpec) -> T.StructType:
    scores = T.MapType(T.StringType(), T.DoubleType())
    fields = [T.StructField(name, T.DoubleType()) for name in spec.binary]
    fields += [T.StructField(name, scores) for name in (*spec.sets, *spec.classes)]
    return T.StructType(fields)


def log_schema(spec: LabelSpec) -> T.StructType:
    """One wide nullable struct for inference and review events."""
    labels = labels_schema(spec)
    string = T.StringType()
    return T.StructType([
        T.StructField("id", string),
        T.StructField("interaction_id", string),
        T.StructField("entry_type", string),
        T.StructField("timestamp", string),
        T.StructField("input", string),
        T.StructField("prediction", labels),
        T.StructField("confidence", confidence_schema(spec)),
        T.StructField("user_feedback", string),
        T.StructField("corrected_labels", labels),
        T.StructField("review_notes", string),
    ])


def label_names(spec: LabelSpec) -> list[str]:
    return [spec.domain, "crops", "topics", *spec.flags, "intent", "urgency"]


def flatten(df: DataFrame, spec: LabelSpec) -> DataFrame:
    """Nested corpus rows to one column per label field.  ``split``,
    ``split_pos`` and ``line_no`` are kept where present."""
    position = [c for c in ("split", "split_pos", "line_no") if c in df.columns]
    labels = [F.col(f"labels.{name}").alias(name) for name in label_names(spec)]
    return df.select(*position, "id", "input", *labels, *[F.col(f"meta.{name}").alias(name) for name in ("source_type", "difficulty", "notes")])


def nest(df: DataFrame, spec: LabelSpec, source_type: str = "synthetic") -> DataFrame:
    """Inverse of :func:`flatten`."""
    position = [c for c in ("split", "split_pos", "line_no") if c in df.columns]
    kind = F.coalesce("source_type", F.lit(source_type)) if "source_type" in df.columns else F.lit(source_type)
    meta = F.struct(kind.alias("source_type"), "difficulty", "notes").alias("meta")
    return df.select(*position, "id", "input", F.struct(*label_names(spec)).alias("labels"), meta)


def order_columns(df: DataFrame) -> list[Column]:
    """Default scan order of a corpus frame."""
    names = [c for c in ("split_pos", "line_no", "id") if c in df.columns]
    return [F.col(c) for c in names]
