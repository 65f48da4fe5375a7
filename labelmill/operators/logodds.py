"""Token log-odds model: fit, store, score and decide.

Counts, weights and sums are integers (weights are stored in units of 1e-4),
so results do not depend on task order.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.config import LabelSpec, Thresholds
from labelmill.functions import text as X
from labelmill.operators.scale import cut_lineage, explode_rows, top_k

# Weights below the minimum are dropped, at most this many are
# kept per head, and weights have four decimals.
MIN_WEIGHT = 0.15
MAX_FEATURES = 120
UNIT = 10_000

# Document frequency from which features are used to find the floors of a fit.
SCREEN_DF = 8

# Models with at most this many (feature, head) cells are looked up inside each
# row of text; beyond it (very large label spaces) scoring goes through a join.
INLINE_CELLS = 200_000
INDEX_BUCKETS = 4096

# Weights that are broadcast at most.
BROADCAST_WEIGHTS = 100_000

# Bits per feature of the filter that drops features a large model lacks, bits
# set per feature, and the most bits a filter has (512 kB).  Beyond about a
# quarter of a million features it lets more through; the join stays exact.
FILTER_BITS = 16
FILTER_HASHES = 3
MAX_FILTER_BITS = 1 << 22

HEADS_SCHEMA = "head int, field string, label string, label_pos int, bias bigint, threshold double"
WEIGHTS_SCHEMA = "head int, feature string, weight bigint"


@dataclass(frozen=True)
class Head:
    """One scored label; ``member`` tells whether a training row belongs to it."""

    field: str
    label: str
    label_pos: int
    member: Column
    threshold: float = 0.5


@dataclass(frozen=True)
class TokenModel:
    """``heads`` and ``weights`` tables; both are bounded by the label spaces."""

    heads: DataFrame
    weights: DataFrame


def heads_of(spec: LabelSpec, thresholds: Thresholds) -> list[Head]:
    """Heads of a label spec: the true side of each flag, then every label of
    the set and class fields."""
    out = [Head(name, "true", 0, F.col(name), thresholds.of(name)) for name in spec.binary]
    for name, space in spec.sets.items():
        out += [Head(name, label, i, F.array_contains(name, label), thresholds.of(name)) for i, label in enumerate(space)]
    for name, space in spec.classes.items():
        out += [Head(name, label, i, F.col(name) == label, thresholds.of(name)) for i, label in enumerate(space)]
    return out


def feature_counts(df: DataFrame, heads: list[Head], text: str = "input", min_df: int = 1) -> DataFrame:
    """Document frequency and per-head positive counts of each feature.

    One shuffle on the feature serves all heads.  ``min_df`` above 1 changes
    results, because rare features can carry weight.
    """
    members = {f"__h{i}": F.coalesce(h.member, F.lit(False)).cast("bigint") for i, h in enumerate(heads)}
    marked = X.add_features(df.select(F.col(text).alias("__text"), *[c.alias(n) for n, c in members.items()]), "__text")
    counted = explode_rows(marked, list(members), "features", "feature").groupBy("feature").agg(
        F.count(F.lit(1)).alias("df"), *[F.sum(n).alias(n) for n in members])
    kept = counted.filter(F.col("df") >= min_df) if min_df > 1 else counted
    return kept.select("feature", "df", F.array(*members).alias("pos"))


def document_frequency(df: DataFrame, text: str = "input") -> DataFrame:
    """Number of documents per feature."""
    exploded = explode_rows(X.add_features(df.select(text), text), [], "features", "feature")
    return exploded.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def fit(df: DataFrame, heads: list[Head], text: str = "input", min_weight: float = MIN_WEIGHT,
        max_features: int = MAX_FEATURES, min_df: int = 1) -> TokenModel:
    """Fit all heads.  Candidates are ranked by the ratio inside the log, which
    is the same order as the absolute weight but free of rounding noise."""
    spark = df.sparkSession
    totals = df.agg(F.count(F.lit(1)).alias("total"),
                    F.array(*[F.count_if(h.member) for h in heads]).alias("pos"))
    described = F.array(*[
        F.struct(F.lit(i).alias("head"), F.lit(h.field).alias("field"), F.lit(h.label).alias("label"),
                 F.lit(h.label_pos).alias("label_pos"), F.lit(h.threshold).alias("threshold"))
        for i, h in enumerate(heads)
    ])
    pos_docs = F.get("pos", F.col("head"))
    head_rows = totals.select("total", "pos", F.inline(described)).select(
        "head", "field", "label", "label_pos",
        F.round(X.log_ratio(pos_docs, F.col("total") - pos_docs) * UNIT).cast("bigint").alias("bias"), "threshold")

    counts = feature_counts(df, heads, text, min_df)
    best = strongest(counts, len(heads), min_weight, max_features)
    weights = best.select("head", "feature", F.round(F.col("raw") * UNIT).cast("bigint").alias("weight"))
    return TokenModel(head_rows, weights)


def _candidates(counts: DataFrame, min_weight: float) -> DataFrame:
    per_head = counts.select("feature", "df", F.posexplode("pos").alias("head", "pos"))
    pos, neg = F.col("pos"), F.col("df") - F.col("pos")
    strength = F.greatest(pos + 1, neg + 1) / F.least(pos + 1, neg + 1)
    return per_head.select("head", "feature", strength.alias("strength"), X.log_ratio(pos, neg).alias("raw")) \
        .filter(F.abs("raw") >= min_weight)


def strongest(counts: DataFrame, heads: int, min_weight: float = MIN_WEIGHT, k: int = MAX_FEATURES,
              screen: int = SCREEN_DF) -> DataFrame:
    """The ``k`` strongest candidates of each head.

    Strength is at most ``df + 1``.  So the k-th strength among the frequent
    features (few rows) is a floor that most rare features cannot reach, and
    only the rest is expanded and ranked per head.  A head with fewer than
    ``k`` frequent candidates gets no floor: the result is exact in any case.
    """
    order = [F.desc("strength"), F.desc("feature")]
    frequent = top_k(_candidates(counts.filter(F.col("df") >= screen), min_weight), ["head"], order, k, "place")
    kth = frequent.filter(F.col("place") == k).select("head", F.col("strength").alias("floor"))
    every = counts.sparkSession.range(heads).select(F.col("id").cast("int").alias("head"))
    floors = every.join(kth, "head", "left").select("head", F.coalesce("floor", F.lit(0.0)).alias("floor"))
    lowest = floors.agg(F.min("floor").alias("lowest")).scalar()
    able = counts.filter(F.col("df") + 1 >= lowest)
    passing = _candidates(able, min_weight).join(F.broadcast(floors), "head").filter(F.col("strength") >= F.col("floor"))
    return top_k(passing.drop("floor"), ["head"], order, k)


def save_model(model: TokenModel, path: str) -> None:
    model.heads.coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")
    model.weights.coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")


def load_model(spark, path: str) -> TokenModel:
    """Stored model; a missing one fails with what to do about it."""
    try:
        heads = spark.read.schema(HEADS_SCHEMA).parquet(f"{path}/heads")
        weights = spark.read.schema(WEIGHTS_SCHEMA).parquet(f"{path}/weights")
    except Exception as error:
        raise FileNotFoundError(f"no token model at {path}; fit one and call save_model first") from error
    return TokenModel(heads, weights)


@dataclass(frozen=True)
class Scorer:
    """A bounded model as expressions; see :func:`compile_model`."""

    heads: list[dict]
    index: Column
    vocabulary: str
    firsts: str = ""
    seconds: str = ""

    def fields(self) -> dict[str, list[int]]:
        """Places of each field's heads, which stand together in head order."""
        out: dict[str, list[int]] = {}
        for i, head in enumerate(self.heads):
            out.setdefault(head["field"], []).append(i)
        if any(places[-1] - places[0] + 1 != len(places) for places in out.values()):
            raise ValueError("heads of one field have to stand together")
        return out


def compile_model(model: TokenModel, limit: int = INLINE_CELLS) -> Scorer | None:
    """Bring a bounded model into expressions, or None when it is too large.

    At most ``limit + 1`` weight rows reach the driver.  They become one folded
    literal, a bucket index from feature hash to the feature's weight per head.
    """
    slot = F.pmod(F.hash("feature"), F.lit(INDEX_BUCKETS))
    rows = model.weights.select("head", "feature", "weight", slot.alias("slot")).limit(limit + 1).collect()
    heads = sorted((r.asDict() for r in model.heads.collect()), key=lambda h: h["head"])
    position = {h["head"]: i for i, h in enumerate(heads)}
    by_feature: dict[tuple[int, str], list[int]] = {}
    for r in rows:
        by_feature.setdefault((r["slot"], r["feature"]), [0] * len(heads))[position[r["head"]]] = r["weight"]
    if len(rows) > limit or len(by_feature) * len(heads) > limit:
        return None
    buckets: list[list[dict]] = [[] for _ in range(INDEX_BUCKETS)]
    for (place, feature), weights in sorted(by_feature.items()):
        buckets[place].append({"f": feature, "w": weights})
    index = F.from_json(F.lit(json.dumps(buckets)), F.lit("array<array<struct<f:string,w:array<bigint>>>>"))
    names = sorted(feature for _, feature in by_feature)
    listed = lambda words: ", ".join("'" + word.replace("'", "\\'") + "'" for word in words)
    # No token has an underscore, so a feature with one is a pair.
    pairs = [name.split("_") for name in names if name.count("_") == 1]
    return Scorer(heads, index, listed(names), *[listed(sorted(set(side))) for side in zip(*pairs)])


def score_inline(df: DataFrame, scorer: Scorer, text: str = "input", out: str = "score_sums") -> DataFrame:
    """Add the integer score of every head as one array, in head order.

    A narrow projection: no explode, no join, no shuffle and no row key.
    Features outside the model are dropped by hash-set tests first: a pair is put
    together only if the model has pairs with either token, and what is left is
    made distinct.  A null text scores as an empty one.
    """
    biases = F.array(*[F.lit(h["bias"]).cast("bigint") for h in scorer.heads])
    if not scorer.vocabulary:
        return df.withColumn(out, biases)
    known = lambda feature, words: F.expr(f"filter({feature}, f -> f IN ({words}))")
    hits = known("__tokens", scorer.vocabulary)
    if scorer.firsts:
        pairs = (f"transform(slice(__tokens, 2, greatest(size(__tokens) - 1, 0)), (b, i) -> "
                 f"CASE WHEN __tokens[i] IN ({scorer.firsts}) AND b IN ({scorer.seconds}) THEN concat(__tokens[i], '_', b) END)")
        hits = F.concat(hits, known(pairs, scorer.vocabulary))
    bucket = lambda f: F.get(scorer.index, F.pmod(F.hash(f), F.lit(INDEX_BUCKETS)))
    found = F.transform("__hits", lambda f: F.get(F.filter(bucket(f), lambda e: e["f"] == f), F.lit(0))["w"])
    sums = F.aggregate("__found", biases, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))
    return (
        df.withColumn("__tokens", X.tokens(F.col(text))).withColumn("__hits", F.array_distinct(hits)).withColumn("__found", found)
        .withColumn(out, F.coalesce(sums, biases)).drop("__tokens", "__hits", "__found")
    )


def _places(feature: Column, bits: int) -> list[Column]:
    """Bits of a feature in a filter of ``bits`` bits."""
    return [F.pmod(F.xxhash64(feature, F.lit(i)), F.lit(bits)) for i in range(FILTER_HASHES)]


def feature_filter(weights: DataFrame, max_bits: int = MAX_FILTER_BITS) -> Callable[[Column], Column]:
    """Test that holds for every feature of ``weights`` and for few others.

    A Bloom filter: Spark sets the bits, and at most ``max_bits`` of them come
    to the driver, as the words of one folded literal.
    """
    features = weights.select("feature").distinct()
    bits = 1024
    wanted = features.count() * FILTER_BITS
    while bits < min(wanted, max_bits):
        bits *= 2
    place = F.explode(F.array(*_places(F.col("feature"), bits))).alias("place")
    bit = F.expr("shiftleft(1L, CAST(place % 64 AS INT))")
    found = features.select(place).groupBy(F.expr("CAST(place DIV 64 AS INT)").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    words = [0] * (bits // 64)
    for r in found:
        words[r["word"]] = r["bits"]
    literal = F.from_json(F.lit(json.dumps(words)), F.lit("array<bigint>"))

    def may_have(feature: Column) -> Column:
        tests = [F.getbit(F.get(literal, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _places(feature, bits)]
        return reduce(lambda a, b: a & b, tests)

    return may_have


def score_arrays(df: DataFrame, model: TokenModel, key: str, text: str = "input",
                 broadcast_weights: int = BROADCAST_WEIGHTS) -> tuple[DataFrame, list[dict]]:
    """(key, score_sums) for models of any size, and the heads in order.

    The weights are written first, as a fit would else run for every use of them.
    They are broadcast if they are few, by count.  Otherwise both sides are
    shuffled and sorted by feature, so that a feature of very many texts can be
    split; features that the model lacks are dropped before that by
    :func:`feature_filter`, inside the rows of text.  Biases are added to the
    gathered sums, whose number the label spaces bound.
    """
    heads = sorted((r.asDict() for r in model.heads.collect()), key=lambda h: h["head"])
    stored = cut_lineage(model.weights)
    features = X.add_features(df.select(key, text), text)
    if stored.limit(broadcast_weights + 1).count() <= broadcast_weights:
        weights = F.broadcast(stored)
    else:
        weights = stored.hint("merge")
        features = features.withColumn("features", F.filter("features", feature_filter(stored)))
    exploded = explode_rows(features, [key], "features", "feature")
    sums = exploded.join(weights, "feature").groupBy(key, "head").agg(F.sum("weight").alias("total"))
    hits = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("head", "total"))).alias("__hits"))
    total = [F.lit(h["bias"]).cast("bigint") + F.coalesce(F.try_element_at("__hits", F.lit(h["head"])), F.lit(0).cast("bigint")) for h in heads]
    return df.select(key).join(hits, key, "left").select(key, F.array(*total).alias("score_sums")), heads


def score_join(df: DataFrame, model: TokenModel, key: str, text: str = "input") -> DataFrame:
    """Integer scores as rows (key, head, total), for models of any size."""
    sums, heads = score_arrays(df, model, key, text)
    rows = F.array(*[F.struct(F.lit(h["head"]).alias("head"), F.get("score_sums", F.lit(i)).alias("total")) for i, h in enumerate(heads)])
    return sums.select(key, F.inline(rows))


def probabilities(sums: str = "score_sums") -> Column:
    """Head sums as probabilities, in head order."""
    return F.transform(sums, lambda total: X.sigmoid(total.cast("double") / F.lit(float(UNIT))))


def _is_binary(heads: list[dict]) -> bool:
    return len(heads) == 1 and heads[0]["label"] == "true"


def add_confidence(df: DataFrame, scorer: Scorer, probs: str = "score_probs", prefix: str = "conf_") -> DataFrame:
    """Scores as columns: a double per binary field, a label map per other."""
    columns = {}
    for name, places in scorer.fields().items():
        heads = [scorer.heads[i] for i in places]
        if _is_binary(heads):
            columns[prefix + name] = F.get(probs, F.lit(places[0]))
        else:
            scores = F.slice(probs, places[0] + 1, len(places))
            columns[prefix + name] = F.map_from_arrays(X.label_array([h["label"] for h in heads]), scores)
    return df.withColumns(columns)


def add_decisions(df: DataFrame, scorer: Scorer, set_fields: tuple[str, ...] = ("topics",), sums: str = "score_sums",
                  probs: str = "score_probs", prefix: str = "model_") -> DataFrame:
    """Decisions: threshold for binary and set fields, best label otherwise.

    Thresholds test the unrounded score; ties go to the earliest label."""
    columns = {}
    for name, places in scorer.fields().items():
        heads = [scorer.heads[i] for i in places]
        first, labels = places[0], X.label_array([h["label"] for h in heads])
        if _is_binary(heads):
            columns[prefix + name] = F.get(probs, F.lit(first)) >= F.lit(heads[0]["threshold"])
        elif name in set_fields:
            limits = F.array(*[F.lit(h["threshold"]) for h in heads])
            columns[prefix + name] = _at_least(labels, probs, first, limits)
        else:
            totals = F.slice(sums, first + 1, len(places))
            columns[prefix + name] = F.get(labels, (F.array_position(totals, F.array_max(totals)) - 1).cast("int"))
    return df.withColumns(columns)


def _at_least(labels: Column, probs: str, first: int, limits: Column) -> Column:
    return F.filter(labels, lambda _, i: F.get(probs, i + first) >= F.get(limits, i))
