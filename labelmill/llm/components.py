"""Connected components of a link table, by alternating large and small stars.

(Kiveris, Lattanzi, Mirrokni, Rastogi and Vassilvitskii, 2014.)  A round hangs
every node's larger neighbours, then its smaller ones, below the smallest node
it knows; the number of rounds grows with the logarithm of a component.  Every
round is a table in the shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelmill.operators.scale import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node with links; ``root`` is the smallest node it reaches.

    ``links`` are pairs of longs in either order; pairs that repeat, nulls and
    links of a node to itself add nothing.  Nodes without links give no row.
    """
    pairs = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = cut_lineage(pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    mark = _mark(now)
    while True:
        now = cut_lineage(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
