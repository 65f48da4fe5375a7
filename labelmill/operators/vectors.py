"""Logistic regression over embedding vectors, with balanced class weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators.scale import cut_lineage, dim, join_by_key

THRESHOLD = 0.5
BINARY_ITERATIONS = 2000
CLASS_ITERATIONS = 2500


def embed(df: DataFrame, encoder: Callable[[Column], Column] | None = None, source: str = "embedding",
          out: str = "vector", normalize: bool = True) -> DataFrame:
    """Vector column from an array column, or from text through ``encoder``
    (for example a pandas UDF given by the caller), L2-normalised."""
    values = F.col(source) if encoder is None else encoder(F.col(source))
    raw = df.withColumn("__raw", array_to_vector(values.cast("array<double>")))
    if not normalize:
        return raw.withColumnRenamed("__raw", out)
    return Normalizer(p=2.0, inputCol="__raw", outputCol=out).transform(raw).drop("__raw")


def cached_embeddings(df: DataFrame, cache: DataFrame | None, encoder: Callable[[Column], Column],
                      text: str = "input") -> tuple[DataFrame, DataFrame]:
    """Embeddings through a cache keyed by text content.

    Returns all rows with ``embedding``, and the new cache rows to append.  A
    null text is the empty text; frequent texts are joined without meeting in
    one task.
    """
    keyed = df.withColumn("content_key", F.md5(F.coalesce(F.col(text), F.lit(""))))
    wanted = keyed.groupBy("content_key").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias(text), F.count(F.lit(1)).alias("__n"))
    missing = wanted if cache is None else wanted.join(cache, "content_key", "left_anti")
    # Written first, so that the encoder runs once per text however often the result is read.
    fresh = cut_lineage(missing.select("content_key", encoder(F.col(text)).alias("embedding")))
    known = fresh if cache is None else cache.select("content_key", "embedding").unionByName(fresh)
    stats = cut_lineage(wanted.select("content_key", "__n").join(known, "content_key", "left"))
    return join_by_key(keyed, stats, "content_key", "__n").drop("content_key", "__n"), fresh


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``n / (classes * n_of_class)`` per row; the class counts are one row per
    class and come from one aggregate."""
    counts = df.groupBy(F.col(label).alias("__label")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.collect()
    total = sum(r["n"] for r in rows)
    table = dim(df.sparkSession, [(r["__label"], total / (len(rows) * r["n"])) for r in rows],
                f"{label} {dict(df.dtypes)[label]}, {out} double")
    return df.join(table, label)


def _regression(features: str, label: str, family: str, iterations: int, strength: float) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="weight", family=family, maxIter=iterations,
        regParam=strength, elasticNetParam=0.0, standardization=False, probabilityCol="__p",
        predictionCol="__y", rawPredictionCol="__r")


@dataclass
class VectorModel:
    """One model per binary field, per label of a set field, and per class field."""

    binary: dict[str, LogisticRegressionModel] = field(default_factory=dict)
    sets: dict[str, dict[str, LogisticRegressionModel]] = field(default_factory=dict)
    classes: dict[str, tuple[list[str], LogisticRegressionModel]] = field(default_factory=dict)


def _fit_flag(df: DataFrame, member: Column, features: str, rows: int) -> LogisticRegressionModel:
    # A ridge of 1/n on the mean loss is the unit L2 penalty on the summed loss.
    labelled = df.select(features, F.coalesce(member, F.lit(False)).cast("int").alias("__member"))
    weighted = balanced_weights(labelled, "__member")
    return _regression(features, "__member", "binomial", BINARY_ITERATIONS, 1.0 / rows).fit(weighted)


def fit(df: DataFrame, binary: Sequence[str] = (), sets: dict[str, Sequence[str]] | None = None,
        classes: dict[str, Sequence[str]] | None = None, features: str = "vector") -> VectorModel:
    """Fit all heads.  Set fields get independent binary models per label, as
    labels may occur together; class fields a multinomial model."""
    data = df.persist()
    try:
        rows = data.count()
        model = VectorModel()
        for name in binary:
            model.binary[name] = _fit_flag(data, F.col(name).cast("boolean"), features, rows)
        for name, space in (sets or {}).items():
            model.sets[name] = {
                label: _fit_flag(data, F.array_contains(name, label), features, rows) for label in space}
        for name, space in (classes or {}).items():
            place = F.array_position(X.label_array(space), F.col(name).cast("string")).cast("int") - 1
            if not data.filter(place.isNull() | (place < 0)).isEmpty():
                raise ValueError(f"{name} has rows without a label of its space")
            labelled = balanced_weights(data.select(features, place.alias("__place")), "__place")
            fitted = _regression(features, "__place", "multinomial", CLASS_ITERATIONS, 1.0 / rows).fit(labelled)
            model.classes[name] = (list(space), fitted)
        return model
    finally:
        data.unpersist()


Scores = Sequence[tuple[str, Column]]


def passes(score: Column, threshold: float = THRESHOLD) -> Column:
    """Decision of a binary field."""
    return (score > threshold).cast("int")


def passing_labels(scores: Scores, threshold: float = THRESHOLD) -> Column:
    """Decision of a set field: all labels at or above the threshold."""
    return F.array_compact(F.array(*[F.when(s >= threshold, F.lit(label)) for label, s in scores])).cast("array<string>")


def _best(scores: Scores) -> Column:
    """Score and label of the best label; of equal ones, the earliest."""
    return F.array_max(F.array(*[
        F.struct(s.alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label")) for i, (label, s) in enumerate(scores)]))


def best_if_passing(scores: Scores, threshold: float = THRESHOLD) -> Column:
    """Decision of an exclusive set field: its best label alone, if that passes."""
    best = _best(scores)
    return F.when(best["score"] >= threshold, F.array(best["label"])).otherwise(X.label_array([])).cast("array<string>")


def best_label(scores: Scores) -> Column:
    """Decision of a class field."""
    return _best(scores)["label"]


def predict(df: DataFrame, model: VectorModel, exclusive: Sequence[str] = ("crops",), threshold: float = THRESHOLD,
            prefix: str = "pred_") -> DataFrame:
    """Predictions of every head.  Set fields take all labels at or above the
    threshold; ``exclusive`` ones only their best label, if it passes."""
    def probability(frame: DataFrame, fitted: LogisticRegressionModel, out: str) -> DataFrame:
        scored = fitted.transform(frame)
        return scored.withColumn(out, vector_to_array("__p")).drop("__p", "__y", "__r")

    out = df
    for name, fitted in model.binary.items():
        out = probability(out, fitted, "__s").withColumn(prefix + name, passes(F.get("__s", F.lit(1)), threshold)).drop("__s")
    for name, heads in model.sets.items():
        scores = []
        for i, (label, fitted) in enumerate(heads.items()):
            out = probability(out, fitted, f"__s{i}")
            scores.append((label, F.get(f"__s{i}", F.lit(1))))
        chosen = best_if_passing(scores, threshold) if name in exclusive else passing_labels(scores, threshold)
        out = out.withColumn(prefix + name, chosen).drop(*[f"__s{i}" for i in range(len(scores))])
    for name, (space, fitted) in model.classes.items():
        scored = fitted.transform(out)
        label = F.element_at(X.label_array(space), F.col("__y").cast("int") + 1)
        out = scored.withColumn(prefix + name, label).drop("__p", "__y", "__r")
    return out


def save(model: VectorModel, path: str) -> None:
    """Store the heads with the MLlib writer, one folder each."""
    for name, fitted in model.binary.items():
        fitted.write().overwrite().save(f"{path}/binary/{name}")
    for name, heads in model.sets.items():
        for label, fitted in heads.items():
            fitted.write().overwrite().save(f"{path}/sets/{name}/{label}")
    for name, (_, fitted) in model.classes.items():
        fitted.write().overwrite().save(f"{path}/classes/{name}")


def load(path: str, binary: Sequence[str] = (), sets: dict[str, Sequence[str]] | None = None,
         classes: dict[str, Sequence[str]] | None = None) -> VectorModel:
    read = LogisticRegressionModel.load
    return VectorModel(
        {name: read(f"{path}/binary/{name}") for name in binary},
        {name: {label: read(f"{path}/sets/{name}/{label}") for label in space} for name, space in (sets or {}).items()},
        {name: (list(space), read(f"{path}/classes/{name}")) for name, space in (classes or {}).items()},
    )
