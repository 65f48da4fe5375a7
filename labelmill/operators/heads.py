"""Logistic regression of all heads over one vector at once.

Every label of a binary or set field is a two-class head, every class field one
head of several classes.  All are fitted together: a pass over the rows gives
the losses and gradients of all heads, so the number of jobs does not depend on
how many labels there are.  Partial sums are added up in two levels of tasks;
what reaches the driver has the size of the model.

The loss is that of :mod:`vectors`: balanced class weights, summed, plus a unit
ridge on coefficients but not on intercepts.  The optimiser is L-BFGS on the
driver, one per head and in step with each other.  The first pass adds up the
Gram matrix of the vectors, whose ridged inverse is each optimiser's first guess
of the curvature; so correlated or long vectors take few passes as well.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators.scale import cut_lineage
from labelmill.operators.vectors import THRESHOLD, best_if_passing, best_label, passes, passing_labels

#: A fit ends when no gradient, per row, is above this.
TOLERANCE = 1e-10
MOST_STEPS = 200
#: Corrections that an optimiser remembers.
MEMORY = 12
#: Partial sums up to this many are added up by the driver, more by tasks before.
FEW_PARTS = 32

_SUMS = "sums binary"


@dataclass(frozen=True)
class Head:
    """``kind`` is binary, set or class; a head of two classes has one row of coefficients, of more classes a row each."""

    field: str
    kind: str
    labels: tuple[str, ...]
    coefficients: np.ndarray
    intercepts: np.ndarray


@dataclass(frozen=True)
class HeadModel:
    heads: tuple[Head, ...]
    #: Passes over the rows that the fit took.
    passes: int = 0

    def of(self, field: str) -> list[Head]:
        return [h for h in self.heads if h.field == field]


def _array(df: DataFrame, features: str) -> Column:
    kind = dict(df.dtypes)[features]
    return vector_to_array(features) if kind == "vector" else F.col(features).cast("array<double>")


class _Rows:
    """Vectors with a last 1, and targets, of one batch."""

    def __init__(self, batch: pa.RecordBatch, heads: int):
        self.x = _matrix(batch.column(0))
        self.y = batch.column(1).flatten().to_numpy().reshape(-1, heads)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return np.concatenate([flat, np.ones((len(flat), 1))], axis=1)


def _packed(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in parts:
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _packed(x.T @ x for x in (_matrix(b.column(0)) for b in batches if len(b)))


def _losses(sizes: Sequence[int], weights: Sequence[np.ndarray], at: Sequence[np.ndarray]):
    """Loss and gradient of every head at its coefficients ``at``, summed over a partition."""
    two = [k for k, n in enumerate(sizes) if n == 2]
    more = [k for k, n in enumerate(sizes) if n > 2]

    def of(batch: pa.RecordBatch) -> np.ndarray:
        rows = _Rows(batch, len(sizes))
        losses, gradients = np.zeros(len(sizes)), [np.empty(0)] * len(sizes)
        if two:
            y = rows.y[:, two]
            w = np.where(y == 1, np.array([weights[k][1] for k in two]), np.array([weights[k][0] for k in two]))
            z = rows.x @ np.concatenate([at[k] for k in two]).T
            losses[two] = (w * np.logaddexp(0, np.where(y == 1, -z, z))).sum(axis=0)
            back = (w * (np.exp(-np.logaddexp(0, -z)) - y)).T @ rows.x
            for i, k in enumerate(two):
                gradients[k] = back[i]
        for k in more:
            y = rows.y[:, k]
            z = rows.x @ at[k].T
            z -= z.max(axis=1, keepdims=True)
            total = np.log(np.exp(z).sum(axis=1, keepdims=True))
            w = weights[k][y]
            losses[k] = (w * (total[:, 0] - z[np.arange(len(y)), y])).sum()
            error = np.exp(z - total)
            error[np.arange(len(y)), y] -= 1
            gradients[k] = ((w[:, None] * error).T @ rows.x).ravel()
        return np.concatenate([losses, *gradients])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(of(b) for b in batches if len(b))

    return sums


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _packed(np.frombuffer(raw) for b in batches for raw in b.column(0).to_pylist())


def _total(rows: DataFrame, sums, parts: int) -> np.ndarray:
    """The sums of all partitions, those of many added up by fewer tasks first."""
    partial = rows.mapInArrow(sums, _SUMS)
    if parts > FEW_PARTS:
        partial = partial.repartition(isqrt(parts)).mapInArrow(_added, _SUMS)
    return np.sum([np.frombuffer(r["sums"]) for r in partial.collect()], axis=0)


class _Descent:
    """L-BFGS for one head: proposes a point, is told its loss and gradient, and proposes the next."""

    def __init__(self, rows: int, width: int, curve: np.ndarray, tolerance: float):
        self.shape, self.curve, self.tolerance = (rows, width), curve, tolerance
        self.point = self.trial = np.zeros(rows * width)
        self.loss, self.gradient = None, None
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.step, self.done = 1.0, False

    def _guess(self, v: np.ndarray) -> np.ndarray:
        return (v.reshape(self.shape) @ self.curve).ravel()

    def _direction(self) -> np.ndarray:
        q, kept = self.gradient.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q = self._guess(q) * ((s @ y) / (y @ self._guess(y)))
        else:
            q = self._guess(q)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def told(self, loss: float, gradient: np.ndarray) -> None:
        ridge = self.trial.reshape(self.shape).copy()
        ridge[:, -1] = 0
        loss, gradient = loss + (ridge * ridge).sum() / 2, gradient + ridge.ravel()
        if self.loss is not None:
            # The allowance is what sums of this size lose to rounding.
            if loss > self.loss + 1e-4 * self.step * (self.gradient @ self.move) + 1e-13 * abs(self.loss):
                self.step /= 2
                self.done = self.step < 1e-8
                self.trial = self.point if self.done else self.point + self.step * self.move
                return
            s, y = self.trial - self.point, gradient - self.gradient
            if s @ y > 1e-300:
                self.pairs = [*self.pairs[1 - MEMORY:], (s, y)]
        self.point, self.loss, self.gradient = self.trial, loss, gradient
        self.done = np.abs(gradient).max() <= self.tolerance
        if not self.done:
            self.move, self.step = self._direction(), 1.0
            self.trial = self.point + self.move


def fit(df: DataFrame, binary: Sequence[str] = (), sets: dict[str, Sequence[str]] | None = None, classes: dict[str, Sequence[str]] | None = None,
        features: str = "vector", tolerance: float = TOLERANCE) -> HeadModel:
    """Fit all heads together.

    A null flag or set is false for every label.  A class field whose row has no
    label of its space raises, and so does a table without rows.  A head whose
    rows are all of one class has that class weighted alone.
    """
    named: list[tuple[str, str, tuple[str, ...], Column]] = [(f, "binary", (f,), F.coalesce(F.col(f).cast("boolean"), F.lit(False)).cast("int")) for f in binary]
    for f, space in (sets or {}).items():
        named += [(f, "set", (label,), F.coalesce(F.array_contains(f, label), F.lit(False)).cast("int")) for label in space]
    for f, space in (classes or {}).items():
        named.append((f, "class", tuple(space), F.coalesce(F.array_position(X.label_array(space), F.col(f).cast("string")), F.lit(0)).cast("int") - 1))
    rows = cut_lineage(df.select(_array(df, features).alias("x"), F.array(*[target for *_, target in named]).alias("y")))
    counts: dict[tuple[int, int], int] = {
        (r["pos"], r["col"]): r["count"] for r in rows.select(F.posexplode("y")).groupBy("pos", "col").count().collect()}
    n = sum(c for (pos, _), c in counts.items() if pos == 0)
    if not n:
        raise ValueError("no rows to fit")
    for k, (f, *_) in enumerate(named):
        if counts.get((k, -1)):
            raise ValueError(f"{f} has rows without a label of its space")
    sizes = [2 if kind != "class" else max(2, len(space)) for _, kind, space, _ in named]
    weights = []
    for k, size in enumerate(sizes):
        present = sum((k, c) in counts for c in range(size))
        weights.append(np.array([n / (present * counts[k, c]) if (k, c) in counts else 0.0 for c in range(size)]))
    parts = rows.rdd.getNumPartitions()
    gram = _total(rows, _grams, parts)
    width = isqrt(len(gram))
    ridge = np.eye(width)
    ridge[-1, -1] = 0
    curve = np.linalg.inv(gram.reshape(width, width) / 4 + ridge)
    shapes = [1 if size == 2 else size for size in sizes]
    descents = [_Descent(shape, width, curve, tolerance * n) for shape in shapes]
    ends = np.cumsum([len(named), *[shape * width for shape in shapes]])
    done = 1
    while not all(d.done for d in descents) and done <= MOST_STEPS:
        found = _total(rows, _losses(sizes, weights, [d.trial.reshape(d.shape) for d in descents]), parts)
        for k, (d, a, b) in enumerate(zip(descents, ends[:-1], ends[1:])):
            if not d.done:
                d.told(found[k], found[a:b])
        done += 1
    made = []
    for (f, kind, labels, _), d in zip(named, descents):
        point = d.point.reshape(d.shape)
        made.append(Head(f, kind, labels, point[:, :-1].copy(), point[:, -1].copy()))
    return HeadModel(tuple(made), done)


def scores(model: HeadModel, vector: Column) -> Column:
    """Chances of all heads in a row: one for a head of two classes, one per class for others."""
    weights = np.concatenate([np.concatenate([h.coefficients, h.intercepts[:, None]], axis=1) for h in model.heads])
    sizes = [len(h.intercepts) for h in model.heads]

    @F.arrow_udf("array<double>")
    def chances(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            z = _matrix(vectors) @ weights.T if len(vectors) else np.empty((0, len(weights)))
            out, at = np.empty_like(z), 0
            for size in sizes:
                part = z[:, at:at + size]
                if size == 1:
                    out[:, at:at + size] = np.exp(-np.logaddexp(0, -part))
                else:
                    e = np.exp(part - part.max(axis=1, keepdims=True))
                    out[:, at:at + size] = e / e.sum(axis=1, keepdims=True)
                at += size
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(weights), pa.int32()), pa.array(out.ravel()))

    return chances(vector)


def predict(df: DataFrame, model: HeadModel, exclusive: Sequence[str] = ("crops",), threshold: float = THRESHOLD, prefix: str = "pred_",
            features: str = "vector") -> DataFrame:
    """Predictions of every field, decided as in :func:`vectors.predict`; the vectors are read once for all heads."""
    out = df.withColumn("__scores", scores(model, _array(df, features)))
    places = np.cumsum([0, *[len(h.intercepts) for h in model.heads]]).tolist()
    columns: dict[str, Column] = {}
    for field in dict.fromkeys(h.field for h in model.heads):
        own = [(h, at) for h, at in zip(model.heads, places) if h.field == field]
        head, at = own[0]
        if head.kind == "binary":
            columns[prefix + field] = passes(F.col("__scores")[at], threshold)
        elif head.kind == "set":
            chances = [(h.labels[0], F.col("__scores")[k]) for h, k in own]
            columns[prefix + field] = best_if_passing(chances, threshold) if field in exclusive else passing_labels(chances, threshold)
        elif len(head.intercepts) == 1:
            one = F.col("__scores")[at]
            columns[prefix + field] = best_label(list(zip(head.labels, [1 - one, one])))
        else:
            columns[prefix + field] = best_label([(label, F.col("__scores")[at + i]) for i, label in enumerate(head.labels)])
    return out.withColumns(columns).drop("__scores")


def save(model: HeadModel, spark: SparkSession, path: str) -> None:
    """One small table: a row per row of coefficients, in order."""
    rows = [(k, i, h.field, h.kind, list(h.labels), h.coefficients[i].tolist(), float(h.intercepts[i])) for k, h in enumerate(model.heads) for i in range(len(h.intercepts))]
    spark.createDataFrame(rows, "head int, place int, field string, kind string, labels array<string>, coefficients array<double>, intercept double").write.mode("error").parquet(path)


def load(spark: SparkSession, path: str) -> HeadModel:
    """The stored heads; the table is as large as the model."""
    found: dict[int, list] = {}
    for r in sorted(spark.read.parquet(path).collect(), key=lambda r: (r["head"], r["place"])):
        found.setdefault(r["head"], []).append(r)
    return HeadModel(tuple(
        Head(rs[0]["field"], rs[0]["kind"], tuple(rs[0]["labels"]), np.array([r["coefficients"] for r in rs]), np.array([r["intercept"] for r in rs])) for rs in found.values()))
