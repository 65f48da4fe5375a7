"""Mixing sources to target weights, on DataFrame functions only.

Every source is one stream of words, cut into blocks of a fixed length.  The
mix is a list of output shards with a fixed number of block slots each.  Per
shard a multinomial draw says how many slots each source fills.  The slots of
a source are numbered over all shards; slot ``j`` is position ``j mod n`` of
pass ``j div n`` over the ``n`` blocks of the source, and a pseudorandom
permutation per source and pass maps the position to a block.  Slots and blocks
meet in an equi-join on (source, block), so no source is read in one task.

A multinomial draw misses its expectation by chance.  The drawn counts are
therefore rescaled per source along the shards, so that a source gets exactly
the words of its target; the last slot is cut to fit.  The short block at the
end of a source is the last of every pass, so all words come equally often, up
to one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import WORD, text_key, whole_text
from labelmill.operators.scale import cut_lineage

BLOCK_WORDS = 512
SHARD_SLOTS = 2048
MAX_REPEATS = 3

#: Rows per bucket; within a bucket the positions of a source are summed up by one task.
BUCKET_ROWS = 1024

#: Cells of the unit interval in which a draw looks for its source.
CELLS = 4096

#: Rounds of the swap-or-not permutation (Hoang, Morris and Rogaway, 2012).
ROUNDS = 24


@dataclass
class Mixed:
    """``rows``: ``row, doc, size, source_size, target``; ``doc`` is a struct of the input columns asked for.
    ``spans``: ``shard, slot, pass, row, first_word, n_words``, the mix itself."""

    rows: DataFrame
    spans: DataFrame
    sources: DataFrame


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeats: int) -> DataFrame:
    """One row per source: ``source, source_no, source_size, weight, target``.

    Sources come by code point, null last, and take the weights in turn.
    Targets share ``share`` of all words by weight; none exceeds
    ``max_repeats`` times its source, and the excess goes to the others by
    weight.  Sources ordered by cap over weight reach their cap in that order,
    so the common level of the rest follows from running sums.
    """
    every = Window.partitionBy(F.lit(0))
    turn = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    filled = Window.partitionBy(F.lit(0)).orderBy("fills_at", "source_no")
    level = (F.lit(float(share)) * F.col("all_words") - F.col("capped")) / F.col("open_weight")
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(turn) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int")))
        .withColumn("all_words", F.sum("source_size").over(every))
        .withColumn("cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", F.max(F.when(level <= F.col("fills_at"), level)).over(every))
        .withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_no", "source_size", "weight", "target")
    )


def permuted(position: Column, n: Column, *keys: Column) -> Column:
    """Pseudorandom permutation of ``0 .. n-1`` for any ``n`` (swap-or-not)."""

    def swap(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("k"), *keys, i), n) + n - x, n)
        bit = F.xxhash64(F.lit("b"), *keys, i, F.greatest(x, partner)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), position, swap)


def mix(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    weights: Sequence[float] = (1, 2, 3),
    share: float = 1.0,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_slots: int = SHARD_SLOTS,
    seed: int = 42,
) -> Mixed:
    """Mix documents (``doc_id, text, source``) to the target of each source.

    Null texts and texts without words have size 0 and are never taken; a null
    source is a source; a source without words has target 0.  Repeated rows
    are rows of their own.  Equal rows may swap places between runs, which
    changes nothing that can be seen.  An empty table gives empty results.
    ``keep`` are the input columns that ``rows`` carries; their names do not
    matter.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.struct(*keep).alias("doc"), F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("source"),
        text_key().alias("__key"), word_count(whole_text()).alias("size"),
    )
    rows = cut_lineage(read.withColumn("row", F.monotonically_increasing_id()))
    narrow = rows.select("row", "__id", "__key", "source", "size")
    sources = cut_lineage(_with_slots(source_targets(narrow, weights, share, max_repeats), block_words, max_repeats))

    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    place = F.xxhash64(F.lit(seed), "__id", "__key")
    bucketed = narrow.withColumn("__place", place).withColumn("bucket", F.pmod("__place", F.lit(buckets)))
    sums = bucketed.groupBy("bucket", "source").agg(F.sum("size").alias("__sum"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    named = sources.withColumnRenamed("source", "__source")
    bases = (
        sums.withColumn("base", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)))
        .join(named, F.col("source").eqNullSafe(F.col("__source")))
        .select(F.col("bucket").alias("__bucket"), "__source", "source_no", "base", "source_size", "target")
    )
    inside = Window.partitionBy("bucket", "source").orderBy("__place", "__id", "__key", "row")
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        bucketed.repartition("bucket").withColumn("__in", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(bases, (F.col("bucket") == F.col("__bucket")) & F.col("source").eqNullSafe(F.col("__source")))
        .select("row", "source_no", "size", "source_size", "target", (F.col("base") + F.col("__in")).alias("start"))
    )
    placed = cut_lineage(placed)
    spans = _spans(placed, _slots(spark, sources, shard_slots, seed), block_words)
    return Mixed(rows.select("row", "doc").join(placed.select("row", "size", "source_size", "target"), "row"), spans, sources)


def _with_slots(targets: DataFrame, block_words: int, max_repeats: int) -> DataFrame:
    """Adds what the slots of a source need: words to take, blocks per pass, and slots."""
    size, words = F.col("source_size"), F.greatest(F.col("source_size"), F.lit(1))
    return (
        targets
        .withColumn("quota", F.least(F.round("target").cast("long"), size * max_repeats))
        .withColumn("full_blocks", F.floor(size / block_words).cast("long"))
        .withColumn("blocks", F.ceil(size / block_words).cast("long"))
        .withColumn("rest", F.when(size > 0, F.col("quota") % words).otherwise(0))
        .withColumn("passes", F.when(size > 0, F.floor(F.col("quota") / words)).otherwise(0).cast("long"))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"))
    )


def _slots(spark, sources: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """All slots of the mix: ``shard, source_no, slot`` with the figures of the source."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    order = Window.partitionBy(F.lit(0)).orderBy("source_no")
    until = F.sum("slots").over(order)
    intervals = (
        sources.filter("slots > 0")
        .select("source_no", ((until - F.col("slots")) / F.lit(float(max(total, 1)))).alias("lo"), (until / F.lit(float(max(total, 1)))).alias("hi"))
        .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    )
    bits = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), 11)
    draws = (
        spark.range(shards * shard_slots if total else 0)
        .select(F.floor(F.col("id") / shard_slots).alias("shard"), (bits / F.lit(float(2**53))).alias("u"))
        .withColumn("cell", F.floor(F.col("u") * CELLS))
    )
    drawn = draws.join(intervals, "cell").filter("u >= lo and u < hi").groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("source_no").orderBy("shard")
    every = Window.partitionBy("source_no")
    #: A source that no draw met goes to one shard.
    some_shard = F.pmod(F.xxhash64(F.lit(seed), "source_no"), F.lit(shards))
    upto = F.floor(F.col("__until") / F.col("__all") * F.col("slots"))
    return (
        sources.filter("slots > 0").join(drawn, "source_no", "left")
        .withColumn("n", F.coalesce("n", F.lit(1))).withColumn("shard", F.coalesce("shard", some_shard))
        .withColumn("__until", F.sum("n").over(along)).withColumn("__all", F.sum("n").over(every))
        .withColumn("__to", upto)
        .withColumn("__from", F.coalesce(F.lag("__to").over(along), F.lit(0)))
        .filter("__to > __from")
        .repartition("source_no", "shard")  # the slots of a large source are listed by many tasks
        .withColumn("slot", F.explode(F.sequence("__from", F.col("__to") - 1)))
        .select("shard", "slot", "source_no", "full_blocks", "blocks", "rest", "passes")
    )


def _spans(placed: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """Slots joined with the parts of documents in their blocks."""
    size = F.lit(block_words)
    drawn = (
        slots.withColumn("pass", F.floor(F.col("slot") / F.col("blocks")))
        .withColumn("__at", F.col("slot") % F.col("blocks"))
        .withColumn("block", F.when(
            F.col("__at") < F.col("full_blocks"),
            permuted(F.col("__at"), F.greatest("full_blocks", F.lit(1)), F.col("source_no"), F.col("pass")),
        ).otherwise(F.col("full_blocks")))
        .withColumn("cut", F.when(F.col("pass") < F.col("passes"), size).otherwise(F.least(size, F.col("rest") - F.col("__at") * size)))
        .select("shard", "slot", "source_no", "pass", "block", "cut")
    )
    end = F.col("start") + F.col("size")
    parts = (
        placed.filter("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))))
        .withColumn("__lo", F.greatest(F.col("start"), F.col("block") * size))
        .withColumn("__hi", F.least(end, (F.col("block") + 1) * size))
        .select("row", "source_no", "block", "start", "__lo", "__hi")
    )
    # Both sides grow with the corpus, and a block has few rows on either: neither is ever broadcast.
    return (
        drawn.hint("merge").join(parts.hint("merge"), ["source_no", "block"])
        .withColumn("n_words", F.least("__hi", F.col("block") * size + F.col("cut")) - F.col("__lo"))
        .filter("n_words > 0")
        .select("shard", "slot", "pass", "row", (F.col("__lo") - F.col("start")).alias("first_word"), "n_words")
    )


def taken_words(mixed: Mixed, *columns: str) -> DataFrame:
    """All rows with ``taken``, the words that the mix takes of them, repeats counted."""
    taken = mixed.spans.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return mixed.rows.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).select(*columns)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document has a row for every pass that takes words of it.  The text of a
    whole pass is the whole text; of a part, the words taken with the white
    space before them, in text order.  ``n_chars``, where there is one, is set
    anew.  Null texts are empty, documents without words are in no pass, repeated
    rows are documents of their own, and an empty table stays empty.
    """
    mixed = mix(docs, keep=docs.columns, **options)
    spans = mixed.spans.groupBy("row", "pass").agg(
        F.sum("n_words").alias("__taken"), F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("__spans"),
    )
    words = F.regexp_extract_all(F.col("doc.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0)
    text = F.when(F.col("__taken") == F.col("size"), F.col("doc.text")).otherwise(F.array_join(
        F.flatten(F.transform("__spans", lambda s: F.slice("__words", (s["first_word"] + 1).cast("int"), s["n_words"].cast("int")))), ""))
    cut = F.when(F.col("__taken") < F.col("size"), words)
    out = mixed.rows.join(spans, "row").withColumn("__words", cut).withColumn("__new", text)
    new = {"text": F.col("__new"), "n_chars": F.length("__new").cast("long")}
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
