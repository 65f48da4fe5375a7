"""Near-duplicate vectors by lattice hashing.

Every table projects a unit vector at random to ``BLOCKS`` times eight
dimensions and decodes each block to its nearest point of the E8 lattice.  The
points of a table's blocks and the label are a cell.  A vector is held under
its own cell, and asks for this cell and for those in which one block moves to
one of the neighbouring lattice points nearest to its projection.  Vectors that
meet in a cell of any table are compared by cosine in double precision, so only
a link can be missed, never made up; `README.md` has the measured recall.

Equal vectors of a label are one class, so copies meet once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.llm.components import components
from labelmill.operators.scale import cut_lineage

COSINE = 0.98
TABLES = 10
BLOCKS = 2
PROBES = 8
SEED = 42

#: Projected length of a unit vector's part per dimension; a link of cosine 0.98 then moves a block by about half the distance between lattice points.
SCALE = 1.0


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, the steps to neighbouring lattice points."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            step = np.zeros(8)
            step[i], step[j] = a, b
            whole.append(step)
    half = [np.array(signs) for signs in product((0.5, -0.5), repeat=8) if sum(s < 0 for s in signs) % 2 == 0]
    return np.array(whole + half)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and if the sum is odd, round the worst coordinate the other way."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the even whole points and their copy moved by a half in every coordinate."""
    whole, half = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


class Tables:
    """Cells of vectors of one dimension."""

    def __init__(self, dimension: int, tables: int, blocks: int, probes: int, seed: int = SEED):
        rng = np.random.default_rng([seed, dimension])
        self.maps = rng.normal(0.0, SCALE, (tables, blocks, dimension, 8))
        self.codes = rng.integers(1, 2**63, (blocks, 8), dtype=np.uint64) | np.uint64(1)
        self.table_codes = rng.integers(1, 2**63, (tables, 2), dtype=np.uint64) | np.uint64(1)
        self.probes, self.steps = probes, roots()

    def _code(self, points: np.ndarray, block: int) -> np.ndarray:
        """64-bit code of lattice points, whose doubled coordinates are whole."""
        return (np.rint(2 * points).astype(np.int64).view(np.uint64) * self.codes[block]).sum(axis=-1, dtype=np.uint64)

    def cells(self, unit: np.ndarray, labels: np.ndarray, ask: bool) -> np.ndarray:
        """(vectors, keys): the own cell per table, and with ``ask`` the neighbouring ones."""
        out = []
        for maps, (base, by_label) in zip(self.maps, self.table_codes):
            own, near = [], []
            for block, m in enumerate(maps):
                x = unit @ m
                points = decode(x)
                own.append(self._code(points, block))
                if ask:
                    # All steps have one length, so the nearest neighbour is the one most in the direction of the rest.
                    best = np.argpartition(-((x - points) @ self.steps.T), self.probes, axis=1)[:, : self.probes]
                    near.append(self._code(points[:, None, :] + self.steps[best], block))
            start = base + labels.astype(np.int64).view(np.uint64) * by_label
            total = start + np.sum(own, axis=0, dtype=np.uint64)
            keys = [total[:, None]] + [total[:, None] - o[:, None] + n for o, n in zip(own, near)]
            out.append(np.concatenate(keys, axis=1))
        return _mixed(np.concatenate(out, axis=1)).view(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _celled(ask: bool, tables: int, blocks: int, probes: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets = np.asarray(batch.column(2).offsets)
            values = np.asarray(batch.column(2).values)
            sizes = np.diff(offsets)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                vectors = np.stack([values[offsets[i]:offsets[i + 1]] for i in at])
                unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                unit /= np.sqrt((unit**2).sum(axis=1, keepdims=True))
                table = made.setdefault(int(size), Tables(int(size), tables, blocks, probes))
                keys = table.cells(unit, labels[at], ask)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at], keys.shape[1])), pa.array(keys.ravel())], names=["class", "cell"])

    return cells


def _classes(vectors: DataFrame) -> DataFrame:
    """Different vectors per label: ``class, label, embedding, scaled, norm, least, n``; vectors that link with nothing are left out."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    # By a power of two, which is exact, so that no square overflows or vanishes.
    by = F.pow(F.lit(2.0), F.least(F.lit(1023.0), -F.floor(F.log2(F.array_max(F.transform("embedding", lambda x: F.abs(x)))))))
    size = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    usable = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", ok)).filter(F.exists("embedding", lambda x: x != 0))
    grouped = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    scaled = grouped.withColumn("by", by).withColumn("scaled", F.transform("embedding", lambda x: x * F.col("by"))).drop("by")
    return cut_lineage(scaled.withColumn("norm", size).withColumn("class", F.monotonically_increasing_id()))


def class_links(classes: DataFrame, cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES) -> DataFrame:
    """``a, b``: pairs of classes of one label that meet in a cell and have at least the cosine."""
    read = classes.select("class", F.col("label").cast("long"), "embedding")
    held = read.mapInArrow(_celled(False, tables, blocks, probes), "class long, cell long").withColumnRenamed("class", "x")
    asked = read.mapInArrow(_celled(True, tables, blocks, probes), "class long, cell long").withColumnRenamed("class", "y")
    met = held.join(asked, "cell").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda name: classes.select(
        F.col("class").alias(name), F.col("label").alias(f"label_{name}"), F.col("scaled").alias(f"v_{name}"), F.col("norm").alias(f"norm_{name}"))
    dot = F.aggregate(F.zip_with("v_a", "v_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (
        met.join(side("a"), "a").join(side("b"), "b")
        .filter((F.col("label_a") == F.col("label_b")) & (F.size("v_a") == F.size("v_b")))
        .filter(dot / (F.col("norm_a") * F.col("norm_b")) >= cosine).select("a", "b")
    )


def linked(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``.

    Rows are compared if their labels are equal and not null.  Null and zero
    vectors and those with null, infinite or NaN parts have no links and are
    their own component; vectors of different length have none with each
    other.  Repeated rows are vectors of their own, so copies link with each
    other.  A null id is never the smallest; it is kept only if its component
    has no id.  An empty table gives no rows.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    classes = _classes(rows)
    links = cut_lineage(class_links(classes, **options))
    counts = classes.select(F.col("class").alias("other"), "n")
    both = links.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("class"), F.col("a").alias("other")))
    others = both.join(counts, "other").groupBy("class").agg(F.sum("n").alias("others"))
    rooted = classes.select("class", "least").join(components(links).withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = (
        rooted.select("class", "root").join(named, "root").join(others, "class", "left")
        .join(classes.select("class", "label", "embedding", "n"), "class")
        .select(F.col("label").alias("__label"), F.col("embedding").alias("__vector"), "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    return (
        rows.join(of_class, (F.col("label") == F.col("__label")) & (F.col("embedding") == F.col("__vector")), "left")
        .withColumn("component_id", F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )
