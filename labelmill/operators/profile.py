"""Corpus statistics, histograms, gates, audits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.config import (
    AUDIT_COMBO_SPARSE, AUDIT_TOPIC_SHARE, LOW_TOPIC_FLOOR, LOW_TOPIC_SHARE, SHORT_WORDS, Band, LabelSpec,
)
from labelmill.functions import text as X
from labelmill.operators.scale import dim, explode_rows, top_k


def text_shape(df: DataFrame, phrases: Sequence[str], text: str = "input", short_words: int = SHORT_WORDS) -> DataFrame:
    """Add word count and the short and vague marks of a text."""
    return df.withColumn("words", X.word_count(F.col(text))).withColumns({
        "is_short": F.col("words") <= short_words,
        "is_vague": X.has_phrase(F.lower(F.col(text)), phrases),
    })


def text_marks(df: DataFrame, phrases: Sequence[str], text: str = "input") -> DataFrame:
    """All marks that need the text, in place of the text: a narrow table.

    Write or checkpoint it when several aggregates follow, so that the texts
    are read once; the operators below use the marks where they are present.
    """
    return text_shape(df, phrases, text).withColumn("norm_key", X.fingerprint(F.col(text))).drop(text)


def corpus_stats(df: DataFrame, domain: str, lead_flag: str, phrases: Sequence[str], text: str = "input",
                 topics: str = "topics", hard: Column | None = None, group: str | None = None) -> DataFrame:
    """One row of corpus statistics (per ``group`` value where given).

    The shape marks are aggregated in the same pass as the label counts.
    """
    is_hard = F.col("difficulty") == "hard" if hard is None else hard
    shaped = df if "is_short" in df.columns else text_shape(df, phrases, text)
    grouped = shaped.groupBy(group) if group else shaped.groupBy()
    in_domain = F.col(domain)
    counted = grouped.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(in_domain).alias("domain_total"),
        F.count_if(F.col("is_short")).alias("short_rows"),
        F.count_if(F.col("is_vague")).alias("vague_rows"),
        F.count_if(F.size(topics) > 1).alias("multi_topic_rows"),
        F.count_if(is_hard).alias("hard_rows"),
        F.count_if(in_domain & F.col(lead_flag)).alias("lead_flag_rows"),
    )
    total = F.col("total")
    return counted.withColumns({
        "non_domain_total": total - F.col("domain_total"),
        "non_domain_ratio": X.safe_div(total - F.col("domain_total"), total),
        "lead_flag_ratio": X.ratio(F.col("lead_flag_rows"), F.col("domain_total")),
        "short_ratio": X.safe_div(F.col("short_rows"), total),
        "vague_ratio": X.safe_div(F.col("vague_rows"), total),
        "multi_topic_ratio": X.safe_div(F.col("multi_topic_rows"), total),
    })


def _pairs(df: DataFrame, scalars: Sequence[str], arrays: Sequence[str], flags: Sequence[str],
           keep: Sequence[str]) -> DataFrame:
    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), value.alias("value"))

    parts = []
    singles = [pair(name, F.col(name).cast("string")) for name in (*scalars, *flags)]
    if singles:
        parts.append(F.array(*singles))
    each = lambda name: F.transform(F.col(name), lambda v: pair(name, v.cast("string")))
    parts += [each(name) for name in arrays]
    return df.select(*keep, F.inline(F.concat(*parts) if len(parts) > 1 else parts[0]))


def histogram(df: DataFrame, scalars: Sequence[str] = (), arrays: Sequence[str] = (),
              flags: Sequence[str] = (), group: Sequence[str] = ()) -> DataFrame:
    """Value counts of scalar, list and flag fields in one pass: (field, value, n)."""
    pairs = _pairs(df, scalars, arrays, flags, group)
    return pairs.groupBy(*group, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def zero_fill(counts: DataFrame, space: DataFrame, on: Sequence[str], n: str = "n") -> DataFrame:
    """All rows of a label dimension, with 0 where nothing was counted."""
    return space.join(counts, list(on), "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))


def with_share(counts: DataFrame, total: DataFrame, column: str, n: str = "n") -> DataFrame:
    """Share of a one-row total (all rows for scalars, domain rows for lists)."""
    one = total.select(F.col(column).alias("__total")).scalar()
    return counts.withColumn("share", X.safe_div(F.col(n), one))


def combo_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows per flag tuple."""
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def combo_minimums(df: DataFrame, flags: Sequence[str], combos: Sequence[tuple]) -> DataFrame:
    """Named flag combinations with their counts, minimums and status."""
    spark = df.sparkSession
    names = ", ".join(f"{flag} boolean" for flag in flags)
    wanted = dim(spark, [(name, *values, low) for name, values, low in combos], f"combo string, {names}, min_n bigint")
    counted = zero_fill(combo_counts(df, flags), wanted, flags)
    return counted.select("combo", "n", "min_n", (F.col("n") >= F.col("min_n")).alias("ok"))


def label_coverage(df: DataFrame, labels: str, space: Sequence[str], domain_total: DataFrame,
                   floor: int = LOW_TOPIC_FLOOR, share: float = LOW_TOPIC_SHARE, zero: bool = True) -> DataFrame:
    """Count per label against ``max(floor, int(domain_total * share))``.

    ``zero`` also reports labels that never occur; without it only labels seen.
    ``domain_total`` is a one-row frame with that column.
    """
    counts = explode_rows(df, [], labels, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    if zero:
        counts = zero_fill(counts, dim(df.sparkSession, [(s,) for s in space], "label string"), ["label"])
    limit = domain_total.select(
        F.greatest(F.lit(floor).cast("bigint"), F.floor(F.col("domain_total") * F.lit(share))).alias("limit_n")
    ).scalar()
    return counts.withColumn("min_n", limit).withColumn("low", F.col("n") < F.col("min_n"))


def check_bands(stats: DataFrame, bands: Sequence[Band], keep: Sequence[str] = ()) -> DataFrame:
    """Each banded statistic with its limits: (check, value, lo, hi, status)."""
    checks = []
    for band in bands:
        value = F.col(band.check).cast("double")
        status = F.lit("ok")
        if band.hi is not None:
            status = F.when(value > band.hi, F.lit(band.high_label)).otherwise(status)
        if band.lo is not None:
            status = F.when(value < band.lo, F.lit(band.low_label)).otherwise(status)
        checks.append(F.struct(
            F.lit(band.check).alias("check"), value.alias("value"), F.lit(band.lo).cast("double").alias("lo"),
            F.lit(band.hi).cast("double").alias("hi"), status.alias("status"),
        ))
    return stats.select(*keep, F.inline(F.array(*checks)))


def distribution_gate(stats: DataFrame, bands: Sequence[Band], combos: DataFrame | None = None,
                      severity: str = "fail") -> DataFrame:
    """Band checks and combination minimums as one table of checks.

    ``severity`` is what an outlier means to the caller: ``fail`` for the hard
    gate, ``warn`` for the report."""
    rows = check_bands(stats, bands)
    if combos is not None:
        rows = rows.unionByName(combos.select(
            F.concat(F.lit("combo:"), F.col("combo")).alias("check"), F.col("n").cast("double").alias("value"),
            F.col("min_n").cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
            F.when(F.col("ok"), F.lit("ok")).otherwise(F.lit("low")).alias("status"),
        ))
    return rows.withColumn("severity", F.when(F.col("status") == "ok", F.lit("none")).otherwise(F.lit(severity)))


def raise_on_fail(checks: DataFrame) -> None:
    """Raise when a gate has failures; the table has one row per check."""
    failed = [r["check"] for r in checks.filter(F.col("severity") == "fail").select("check").collect()]
    if failed:
        raise ValueError("distribution gate failed: " + ", ".join(sorted(failed)))


def audit_findings(stats: DataFrame, bands: Sequence[Band], combos: DataFrame, topics: DataFrame,
                   duplicates: DataFrame, sparse: int = AUDIT_COMBO_SPARSE,
                   topic_share: tuple[float, float] = AUDIT_TOPIC_SHARE) -> DataFrame:
    """Findings (kind, subject, value) of an audit; one ``none`` row when clean.

    ``combos`` has (combo, n), ``topics`` (value, n) of topics seen, and
    ``duplicates`` one row with ``duplicate_groups``.
    """
    domain_total = stats.select("domain_total").scalar()
    share = X.ratio(F.col("n"), domain_total)
    banded = check_bands(stats, bands).filter(F.col("status") != "ok").select(
        F.col("status").alias("kind"), F.col("check").alias("subject"), "value")
    combo = combos.filter(F.col("n") < sparse).select(
        F.when(F.col("n") == 0, F.lit("missing_combo")).otherwise(F.lit("sparse_combo")).alias("kind"),
        F.col("combo").alias("subject"), F.col("n").cast("double").alias("value"))
    topic = topics.withColumn("share", share).select(
        F.when(F.col("share") < topic_share[0], F.lit("rare_topic"))
        .when(F.col("share") > topic_share[1], F.lit("frequent_topic")).alias("kind"),
        F.col("value").alias("subject"), F.col("share").alias("value"),
    ).filter(F.col("kind").isNotNull())
    dup = duplicates.filter(F.col("duplicate_groups") > 0).select(
        F.lit("duplicate_inputs").alias("kind"), F.lit("input").alias("subject"),
        F.col("duplicate_groups").cast("double").alias("value"))
    found = banded.unionByName(combo).unionByName(topic).unionByName(dup)
    # The outer side is one fixed row, so that a clean audit still reports.
    clean = dim(stats.sparkSession, [(1,)], "__one int")
    joined = clean.join(found.withColumn("__one", F.lit(1)), "__one", "left")
    return joined.select(
        F.coalesce("kind", F.lit("none")).alias("kind"), F.coalesce("subject", F.lit("none")).alias("subject"),
        F.coalesce("value", F.lit(0.0)).alias("value"))


def audit_diff(stats: DataFrame, snapshot: str, before: str, after: str, metrics: Sequence[str]) -> DataFrame:
    """Two snapshots of statistics side by side: (metric, before, after, delta)."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])
    long = stats.select(snapshot, F.inline(cells))
    side = lambda name: F.max(F.when(F.col(snapshot) == name, F.col("value")))
    return (
        long.groupBy("metric").agg(side(before).alias("before"), side(after).alias("after"))
        .withColumn("delta", F.col("after") - F.col("before"))
    )


def duplicate_groups(df: DataFrame, text: str = "input", position: Sequence[str] = ("id",)) -> DataFrame:
    """Normalised texts that occur more than once, with count and first row.

    Groups are keyed by fingerprint: whole texts are never shuffled, and a hot
    text collapses to one partial row per task.  ``first`` is the position
    itself for one position column, else a struct.
    """
    first = F.min(F.col(position[0]) if len(position) == 1 else F.struct(*position)).alias("first")
    keyed = df if "norm_key" in df.columns else df.withColumn("norm_key", X.fingerprint(F.col(text)))
    return (
        keyed.select("norm_key", *position)
        .groupBy("norm_key").agg(F.count(F.lit(1)).alias("n"), first)
        .filter(F.col("n") > 1)
    )


def dataset_overview(df: DataFrame, spec: LabelSpec) -> DataFrame:
    """Counts of domain, crops, topics, intents and positive flags: (field, value, n)."""
    counted = histogram(df, [spec.domain, "intent"], ["crops", "topics"], list(spec.flags))
    positive = ~F.col("field").isin(list(spec.flags)) | (F.col("value") == "true")
    return counted.filter(positive)


def class_samples(df: DataFrame, classes: dict[str, Column], order: Sequence[Column], k: int = 3) -> DataFrame:
    """First ``k`` rows of each named class in scan order, all classes in one scan."""
    names = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in classes.items()]))
    return top_k(df.withColumn("class", F.explode(names)), ["class"], order, k, "pick")


def combo_classes(flags: Sequence[str], combos: Sequence[tuple], domain: str) -> dict[str, Column]:
    """Sample classes for exact flag combinations of domain rows."""
    def exact(values: Sequence[bool]) -> Column:
        vector = F.array(*[F.col(flag) for flag in flags])
        return F.col(domain) & (vector == F.array(*[F.lit(v) for v in values]))

    return {name: exact(values) for name, values, *_ in combos}


def module_activation(df: DataFrame, modules: dict[str, str], none: str = "none") -> DataFrame:
    """Rows that would start each downstream module, or none at all."""
    active = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(m)) for flag, m in modules.items()]))
    listed = X.default_list(active.cast("array<string>"), none)
    return df.select(F.explode(listed).alias("module")).groupBy("module").agg(F.count(F.lit(1)).alias("n"))


def split_expectation(df: DataFrame, expected: Sequence[tuple[str, int]], split: str = "split") -> DataFrame:
    """Actual against expected rows per split; a missing split counts 0."""
    wanted = dim(df.sparkSession, list(expected), "split string, expected bigint")
    actual = df.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("actual"))
    joined = wanted.join(actual, "split", "full")
    filled = joined.select(
        "split", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return filled.withColumn("ok", F.col("expected") == F.col("actual"))
