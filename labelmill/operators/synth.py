"""Template grids, unique builders with quotas, id and split assignment, and
ranked rewrites.

Grids grow from a base table by exploding small literal lists, so there is no
join between tables.  Ranks over whole tables use range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators.scale import cut_lineage, dim, first_n, global_rank, top_k


def template_grid(base: DataFrame, category: str, templates: Sequence[str], slots: dict[str, Column],
                  lists: dict[str, Sequence[str]] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Every base row with every value of ``lists`` and every template filled.

    Adds ``category``, ``template_pos``, ``candidate`` and the array
    ``order_key`` (base order, list positions, template position), which sorts
    candidates in nested-loop order.  Base rows are dealt out first, while they
    are few and narrow: one small file may hold them all, and the task that
    reads it would go on with all candidates.
    """
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = base.repartition(tasks, *order, *slots.values())
    positions = [F.col(c) for c in order]
    filled = dict(slots)
    for name, values in (lists or {}).items():
        grid = grid.select("*", F.posexplode(X.label_array(values)).alias(f"__{name}_pos", f"__{name}"))
        positions.append(F.col(f"__{name}_pos"))
        filled[name] = F.col(f"__{name}")
    grid = grid.select("*", F.posexplode(X.label_array(templates)).alias("template_pos", "__template"))
    helpers = [f"__{n}{s}" for n in (lists or {}) for s in ("", "_pos")]
    return grid.withColumns({
        "category": F.lit(category),
        "candidate": X.fill_template(F.col("__template"), **filled),
        "order_key": F.array(*[p.cast("bigint") for p in [*positions, F.col("template_pos")]]),
    }).drop("__template", *helpers)


def indexed_labels(grid: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """Labels that depend on the template index, given as expressions."""
    return grid.withColumns(labels)


def cyclic_labels(index: Column, intents: Sequence[str], urgencies: Sequence[str], hard: Column | bool = False) -> dict[str, Column]:
    """Intent, urgency and difficulty that cycle with an index; every fourth
    row and every marked row is hard, other odd rows medium, even ones simple."""
    marked = F.lit(hard) if isinstance(hard, bool) else hard
    return {
        "intent": X.cyclic_pick(intents, index),
        "urgency": X.cyclic_pick(urgencies, index),
        "difficulty": F.when(marked | (F.pmod(index, F.lit(4)) == 0), F.lit("hard"))
        .when(F.pmod(index, F.lit(2)) == 1, F.lit("medium")).otherwise(F.lit("simple")),
    }


def recycled(candidates: DataFrame, suffix: str = ", please.", text: str = "candidate", order: str = "order_key",
             passes: int = 2) -> DataFrame:
    """Candidates once more with a suffix, behind the plain ones in order."""
    again = F.concat(F.regexp_replace(F.col(text), r"\?+\z", ""), F.lit(suffix))
    listed = candidates.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    return listed.withColumns({
        text: F.when(F.col("pass") == 0, F.col(text)).otherwise(again),
        order: F.concat(F.array(F.col("pass").cast("bigint")), F.col(order)),
    })


def _first_of_keys(candidates: DataFrame, groups: Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """First candidate of each normalised text in each group, without blank texts."""
    named = candidates.withColumn("norm_key", X.fingerprint(F.col(text)))
    payload = [c for c in candidates.columns if c not in (*order, *groups)]
    # Blank texts are dropped after the aggregate, through an aggregated mark:
    # a filter on the key itself would normalise every text twice.
    blank = F.col("norm_key").isin("", X.BLANK_KEY)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = named.groupBy("norm_key", *groups).agg(
        F.min_by(F.struct(*order, *payload), place).alias("row"), F.max(blank.cast("int")).alias("blank"))
    return first.filter(F.col("blank") == 0).select("norm_key", *groups, "row.*")


def _new_to(fresh: DataFrame, existing: DataFrame, existing_text: str) -> DataFrame:
    """Rows whose key no text of the corpus has.

    Candidates are written first, so that their size is known: where they are
    few, the corpus is filtered by their keys before anything of it is shuffled.
    """
    fresh = cut_lineage(fresh)
    corpus = existing.select(X.fingerprint(F.col(existing_text)).alias("norm_key"))
    known = corpus.join(fresh.select("norm_key"), "norm_key", "left_semi").distinct()
    return fresh.join(known, "norm_key", "left_anti")


def unique_candidates(candidates: DataFrame, existing: DataFrame | None, order: Sequence[str] = ("order_key",),
                      text: str = "candidate", existing_text: str = "input") -> DataFrame:
    """First candidate of each normalised text, without blank texts and texts
    of the existing corpus.  One aggregate; hot texts combine before it."""
    fresh = _first_of_keys(candidates, [], order, text)
    return fresh if existing is None else _new_to(fresh, existing, existing_text)


def fill_quotas(categories: Sequence[tuple[DataFrame, str, int]], existing: DataFrame | None,
                order: Sequence[str] = ("order_key",), text: str = "candidate", existing_text: str = "input") -> DataFrame:
    """Accept candidates category by category up to each quota.

    A text accepted earlier blocks later categories; a text left over when a
    quota was full stays available to them.  Earlier categories can block no
    more texts than their quotas, so a category needs only its first ``quota``
    plus the sum of the earlier quotas.  All categories are made unique and cut
    to that in one go, whatever their number; what is left is bounded by the
    quotas and accepted in turn by one task, which sees keys alone.  All
    categories share one schema.  Adds ``norm_key``, ``category`` and
    ``category_pos``.
    """
    named = [c.withColumns({"category": F.lit(name), "category_pos": F.lit(place)}) for place, (c, name, _) in enumerate(categories)]
    offered = reduce(DataFrame.unionByName, named)
    fresh = _first_of_keys(offered, ["category_pos"], order, text)
    if existing is not None:
        fresh = _new_to(fresh, existing, existing_text)
    quotas = [quota for _, _, quota in categories]
    limits = list(accumulate(quotas))
    enough = F.element_at(F.array(*map(F.lit, limits)), F.col("category_pos") + 1)
    ranked = top_k(fresh, ["category_pos"], [F.col(c) for c in order], limits[-1], "__rank")
    able = cut_lineage(ranked.filter(F.col("__rank") <= enough))

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, left = set(), list(quotas)
        for batch in batches:
            keep = []
            for place, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keep.append(left[place] > 0 and key not in taken)
                if keep[-1]:
                    taken.add(key)
                    left[place] -= 1
            yield batch.filter(pa.array(keep, pa.bool_()))

    keys = able.select("category_pos", "norm_key", "__rank").repartition(1).sortWithinPartitions("category_pos", "__rank").select("category_pos", "norm_key")
    chosen = keys.mapInArrow(accept, keys.schema)
    return able.drop("__rank").join(chosen, ["category_pos", "norm_key"], "left_semi")


def quota_shortfall(accepted: DataFrame, quotas: Sequence[tuple[str, int]]) -> DataFrame:
    """Accepted rows against the quota of each category."""
    wanted = dim(accepted.sparkSession, list(quotas), "category string, quota bigint")
    counted = accepted.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    filled = wanted.join(counted, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("missing", F.col("quota") - F.col("n"))


def ensure_quotas(accepted: DataFrame, quotas: Sequence[tuple[str, int]]) -> None:
    short = [(r["category"], r["missing"]) for r in quota_shortfall(accepted, quotas).filter("missing <> 0").collect()]
    if short:
        raise ValueError("quotas not met: " + ", ".join(f"{c} lacks {m}" for c, m in short))


def assign_ids(accepted: DataFrame, existing: DataFrame, order: Sequence[Column], existing_id: str = "id",
               prefix: str = "route_") -> DataFrame:
    """Sequential ids after the largest existing one, accepted rows only."""
    top = existing.select(F.coalesce(F.max(X.id_number(F.col(existing_id))), F.lit(0)).alias("m")).scalar()
    ranked = global_rank(accepted, order, "add_pos")
    return ranked.withColumn("id", X.build_id(F.col("add_pos") + top, prefix))


def allocate_splits(ranked: DataFrame, quotas: Sequence[tuple[str, int]], position: str = "add_pos") -> DataFrame:
    """Split by cumulative quota over a 1-based position; the rest is null."""
    edge, split = 0, F.lit(None).cast("string")
    whens = None
    for name, n in quotas:
        edge += n
        whens = (F if whens is None else whens).when(F.col(position) <= edge, F.lit(name))
    return ranked.withColumn("split", split if whens is None else whens)


def allocate_stratified(rows: DataFrame, stratum: Sequence[str], key: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """Split by a hash of the row key, so every stratum is spread over all
    splits in the given shares, without ranking anything."""
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in (*stratum, key)])
    point = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    edge, whens = 0.0, None
    for name, share in shares[:-1]:
        edge += share
        whens = (F if whens is None else whens).when(point < edge, F.lit(name))
    last = F.lit(shares[-1][0])
    return rows.withColumn("split", last if whens is None else whens.otherwise(last))


def pick_rows(rows: DataFrame, wanted: Column, key: str, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows that satisfy a condition: (key, pick), picks from 0.

    Only the key and the order columns are sorted, never the texts."""
    narrow = rows.filter(wanted).select(key, *[c for c in order if c != key])
    ordering = [F.col(c) for c in order]
    return global_rank(first_n(narrow, ordering, n), ordering, "pick").select(key, (F.col("pick") - 1).alias("pick"))


def phrase_pool(phrases: DataFrame, existing: DataFrame, order: Sequence[str], n: int, text: str = "phrase",
                existing_text: str = "input") -> DataFrame:
    """First ``n`` phrases that are new to the corpus and to each other, ranked."""
    fresh = unique_candidates(phrases, existing, order, text, existing_text)
    ordering = [F.col(c) for c in order]
    ranked = global_rank(first_n(fresh, ordering, n), ordering, "pick")
    return ranked.select((F.col("pick") - 1).alias("pick"), text)


def ranked_rewrite(rows: DataFrame, picks: DataFrame, pool: DataFrame, key: str, text: str, phrase: str = "phrase",
                   updates: dict[str, Column] | None = None) -> DataFrame:
    """Give the k-th picked row the k-th pooled phrase; all other rows, and
    picks beyond the pool, stay as they are.  ``updates`` may use ``pick``."""
    # Written, so that the join to all rows knows how small the matches are and
    # need not shuffle the texts.
    matched = cut_lineage(picks.select(key, "pick").join(pool.select("pick", F.col(phrase).alias("__new")), "pick"))
    joined = rows.join(matched, key, "left")
    changed = F.col("__new").isNotNull()
    out = joined.withColumn("rewritten", changed).withColumn(text, F.coalesce("__new", text))
    for name, value in (updates or {}).items():
        out = out.withColumn(name, F.when(changed, value).otherwise(F.col(name)))
    return out.drop("pick", "__new")


def topic_rewrite(picked: DataFrame, templates: dict[str, Sequence[str]], slots: dict[str, Sequence[str]],
                  fallbacks: Sequence[tuple[Column, str]], default: str, topic: Column, index: str = "pick",
                  extra: dict[str, Column] | None = None) -> DataFrame:
    """New text by the row's first topic: the topic's templates in turn, else
    the first fallback whose condition holds, else the default.  Slot lists are
    picked by the same index; ``extra`` gives further slot columns."""
    turn = F.col(index)
    chosen = None
    for name, texts in templates.items():
        chosen = (F if chosen is None else chosen).when(topic == name, X.cyclic_pick(texts, turn))
    for condition, template in fallbacks:
        chosen = (F if chosen is None else chosen).when(condition, F.lit(template))
    template = F.lit(default) if chosen is None else chosen.otherwise(F.lit(default))
    values = {name: X.cyclic_pick(choices, turn) for name, choices in slots.items()}
    return picked.withColumn("new_text", X.fill_template(template, **values, **(extra or {})))
