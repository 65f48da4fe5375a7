"""One-permutation MinHash fingerprints, on DataFrame functions only.

A shingle is five words.  Words are hashed once and shingles from the hashes of
their words.  The first byte of a shingle's hash is its bin, the rest its value,
and a bin keeps its smallest value: sorting the hashes of a text together with
one largest value per bin leaves the bins' minima at the places where the bin
changes, in order.

Empty bins are filled by optimal densification (Shrivastava, 2017): bin ``i``
tries bins in an order of its own, which is the same for all texts, and takes
the value of the first filled one.  The first places of that order come from a
table; the bins that are still empty then follow by the hash of both bins.

A fingerprint is the low ``BITS`` bits of every bin's value, hashed with the bin
so that a value that fills many bins has bits of its own in each, packed as hex
digits.  Two different values agree in them by chance with probability
``2**-BITS``, which the likeness takes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import SPACE, whole_text
from labelmill.operators.scale import cut_lineage, global_rank

WORDS = 5

#: Bins are told apart by the first byte of a hash.
BINS = 256

#: One hex digit per bin.
BITS = 4

#: Places of the densification order that come from a table.
TRIES = 12

_MASK = 2**64 - 1


def _mixed(x: int) -> int:
    """Finalizer of splitmix64; tables below are made of it by rule."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _words(text: Column) -> Column:
    """Hashes of the words; a text without words has the hash of the empty word."""
    return F.transform(F.split(F.btrim(text, F.lit(SPACE)), r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))


def _pairs(a: Column, b: Column) -> Column:
    """Hashes of elements of ``a`` with those of ``b`` at the same place, as far as ``b`` goes."""
    return F.zip_with(F.slice(a, F.lit(1), F.size(b)), b, lambda x, y: F.xxhash64(x, y))


def _from(array: Column, start: int) -> Column:
    return F.slice(array, F.lit(start), F.greatest(F.size(array) - (start - 1), F.lit(0)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, the fingerprint of the text column: 256 hex digits.

    Null is the empty text.  A text of fewer than five words is one shingle, so
    all texts without words have the same fingerprint, and a repeated shingle
    counts once.
    """
    own = [c for c in df.columns if c != name]
    bin_of = lambda h: F.shiftright(h, 56)  # noqa: E731  -128 .. 127, ascending with h
    step = lambda frame, **new: frame.withColumns({f"__{k}": v for k, v in new.items()})
    empty = F.array(*[F.lit((b << 56) + 2**56 - 1) for b in range(-BINS // 2, BINS // 2)])
    orders = F.array(*[F.array(*[F.lit(_mixed(_mixed(i) + t) % BINS + 1) for t in range(TRIES)]) for i in range(BINS)])
    low = lambda h: F.when(h.bitwiseAND(F.lit(2**56 - 1)) != 2**56 - 1, h)  # noqa: E731  null if the bin is empty

    out = step(df.select(*own), words=_words(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    out = step(out, two=_pairs(F.col("__words"), _from(F.col("__words"), 2)))
    out = step(out, four=_pairs(F.col("__two"), _from(F.col("__two"), 3)))
    shingles = F.when(F.size("__words") < WORDS, F.array(F.aggregate("__words", F.lit(42).cast("long"), lambda a, w: F.xxhash64(a, w))))
    out = step(out, sorted=F.sort_array(F.concat(shingles.otherwise(_pairs(F.col("__four"), _from(F.col("__words"), 5))), empty)))
    heads = F.zip_with(
        "__sorted", F.concat(F.array(F.lit(None).cast("long")), F.slice("__sorted", F.lit(1), F.size("__sorted") - 1)),
        lambda h, before: F.when(before.isNull() | (bin_of(h) != bin_of(before)), h),
    )
    out = step(out, bins=F.transform(F.filter(heads, lambda h: h.isNotNull()), low))
    out = step(out, filled=F.filter("__bins", lambda h: h.isNotNull()))

    def value(h: Column, i: Column) -> Column:
        tries = [F.element_at("__bins", F.element_at(F.element_at(F.col("__orders"), i + 1), t + 1)) for t in range(TRIES)]
        last = F.array_min(F.transform("__filled", lambda f: F.struct(F.xxhash64(i, bin_of(f)).alias("by"), f.alias("value"))))["value"]
        return F.coalesce(h, *tries, F.when(F.size("__filled") > 0, last))

    digit = lambda h, i: F.substring(F.lit("0123456789abcdef"), F.xxhash64(h, i).bitwiseAND(F.lit(2**BITS - 1)).cast("int") + 1, F.lit(1))
    out = out.withColumn("__orders", orders)
    return out.select(*own, F.array_join(F.transform("__bins", lambda h, i: digit(value(h, i), i)), "").alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, from 0 to 1.

    Different values agree in ``BITS`` bits with probability ``c = 2**-BITS``;
    of a share ``m`` of equal bins, ``(m - c) / (1 - c)`` is left.
    """
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))


def _places(docs: DataFrame) -> DataFrame:
    """For every document the one before it in the order of descending ids, cyclic.

    ``id, key`` of the document; ``to_id, to_key, to_none, to_chars`` of the one
    whose next it is.  Only narrow rows are ranked, by ranges of ids.
    """
    ids = docs.groupBy("id", "key", "none").agg(F.first("n_chars").alias("n_chars"))
    ranked = cut_lineage(global_rank(ids, [F.col("none"), F.col("id").desc(), F.col("key")], "place"))
    n = F.lit(ranked.count())
    before = ranked.select(
        F.when(F.col("place") == n, 1).otherwise(F.col("place") + 1).alias("place"),
        F.col("id").alias("to_id"), F.col("key").alias("to_key"), F.col("none").alias("to_none"), F.col("n_chars").alias("to_chars"),
    )
    return ranked.select("place", "id", "key").join(before, "place").drop("place")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and their likeness.

    The edited text has the last half of a text's code points (rounded down)
    replaced by the first as many, or all, of the next document by descending
    id; the last document is followed by the first.  Equal ids are ordered by
    a hash of the text, null ids come last, null texts are empty.  Rows that
    agree in id and text have one place in the order, and each gives the same
    result; a single document is its own next.  An empty table gives no rows.

    Texts are shuffled once, by document; the halves that go to other documents
    are cut before they are shuffled.
    """
    read = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.col("doc_id").isNull().alias("none"), F.xxhash64(whole_text(), F.col("doc_id").isNull()).alias("key"),
        whole_text().alias("text"),
    ).withColumn("n_chars", F.length("text").cast("long"))
    places = _places(read.select("id", "key", "none", "n_chars"))
    # Both joins read the same columns of it, so that Spark shuffles it once for both.
    base = with_fingerprint(read.select("id", "key", "text"), "text", "fingerprint")
    half = lambda n: F.floor(n / 2).cast("int")
    given = (
        base.join(places, ["id", "key"])
        .select("to_id", "to_key", "to_none", F.left("text", half(F.col("to_chars"))).alias("half"), F.col("fingerprint").alias("next_fingerprint"))
        .groupBy("to_id", "to_key").agg(*[F.first(c).alias(c) for c in ("to_none", "half", "next_fingerprint")])
        .select(F.col("to_id").alias("id"), F.col("to_key").alias("key"), "to_none", "half", "next_fingerprint")
    )
    n_chars = F.length("text")
    edited = base.join(given, ["id", "key"]).select(
        F.when(~F.col("to_none"), F.col("id")).alias("doc_id"), n_chars.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
        F.concat(F.left("text", n_chars - half(n_chars)), "half").alias("edited"))
    return (
        with_fingerprint(edited, "edited", "edited_fingerprint")
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
        .withColumn("near_next", likeness(F.col("fingerprint"), F.col("next_fingerprint")))
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    )
