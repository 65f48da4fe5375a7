"""Comparison of predictions with truth: metrics, confusion, routing decisions
and error records.

Everything is derived from one long table of (field, label, true, pred) counts,
which is built in a single pass with map-side combining and whose size depends
only on the label spaces.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators.scale import dim, top_k


#: Class of rows without a prediction.
UNPREDICTED = "(none)"


@dataclass(frozen=True)
class EvalFields:
    """Fields to compare; columns are ``true_<name>`` and ``pred_<name>``."""

    binary: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    sets: dict[str, tuple[str, ...]] = field(default_factory=dict)


def prediction_frame(truth: DataFrame, pred: DataFrame, fields: Sequence[str], key: str = "id",
                     split: str | None = None, keep: Sequence[str] = ("input",)) -> DataFrame:
    """Truth and predictions joined on the key, never by position.

    Every row of the truth stays.  One without a prediction is counted as wrong:
    its flags are the opposite of the true ones, its class is ``UNPREDICTED``,
    its lists are null and differ from any list.
    """
    left = truth.select(key, *keep, *[F.col(c).alias(f"true_{c}") for c in fields])
    right = pred.select(key, *[F.col(c).alias(f"pred_{c}") for c in fields])
    kinds = dict(right.dtypes)
    frame = left.join(right.withColumn("__predicted", F.lit(True)), key, "left")
    missing = F.col("__predicted").isNull()
    fill = {}
    for c in fields:
        kind = kinds[f"pred_{c}"]
        if kind == "boolean":
            fill[f"pred_{c}"] = F.when(missing, ~F.col(f"true_{c}").cast("boolean")).otherwise(F.col(f"pred_{c}"))
        elif kind in ("int", "bigint", "tinyint", "smallint"):
            fill[f"pred_{c}"] = F.when(missing, (1 - F.col(f"true_{c}").cast("int")).cast(kind)).otherwise(F.col(f"pred_{c}"))
        elif kind == "string":
            fill[f"pred_{c}"] = F.when(missing, F.lit(UNPREDICTED)).otherwise(F.col(f"pred_{c}"))
    frame = frame.withColumns(fill).drop("__predicted")
    if split is not None:
        frame = frame.withColumn("split", F.lit(split))
    counts = {f"{name.removesuffix('s')}_count": F.size(f"true_{name}") for name in ("topics", "crops") if name in fields}
    return frame.withColumns(counts) if counts else frame


KINDS = ("binary", "class", "set", "subset")


def outcome_counts(frame: DataFrame, fields: EvalFields) -> DataFrame:
    """Counts (kind, field, label, t, p, n).  Set fields give one 0/1 pair per
    label of their space, plus one exact-match pair (kind ``subset``)."""
    def cell(kind: str, name: str, label: Column, t: Column, p: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("field"), label.alias("label"),
                        t.cast("string").alias("t"), p.cast("string").alias("p"))

    none = F.lit(None).cast("string")
    cells = [
        cell("binary", c, none, F.col(f"true_{c}").cast("int"), F.col(f"pred_{c}").cast("int")) for c in fields.binary
    ]
    cells += [cell("class", c, none, F.col(f"true_{c}"), F.col(f"pred_{c}")) for c in fields.classes]
    for name, space in fields.sets.items():
        true, pred = F.col(f"true_{name}"), F.col(f"pred_{name}")
        in_true = [F.array_contains(true, label) for label in space]
        in_pred = [F.coalesce(F.array_contains(pred, label), ~F.array_contains(true, label)) for label in space]
        cells += [
            cell("set", name, F.lit(label), t.cast("int"), p.cast("int"))
            for label, t, p in zip(space, in_true, in_pred)
        ]
        differs = X.lists_differ(X.decode_hot(X.multi_hot(true, space, False), space),
                                 X.decode_hot(X.multi_hot(pred, space, False), space), ordered=True)
        cells.append(cell("subset", name, none, F.lit(1), F.coalesce((~differs).cast("int"), F.lit(0))))
    counted = frame.select(F.inline(F.array(*cells))).groupBy("kind", "field", "label", "t", "p").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.array_position(X.label_array(KINDS), F.col("kind"))).alias("code"))
    # ``kind`` is read from an aggregate, because filters on a grouping column
    # would move below the aggregate and give every metric its own pass.  The
    # aggregate is a number, because one over strings would sort all rows.
    kind = F.element_at(X.label_array(KINDS), F.col("code").cast("int"))
    return counted.select(kind.alias("kind"), "field", "label", "t", "p", "n")


def _tp_fp_fn(counts: DataFrame, *keys: str) -> DataFrame:
    t, p, n = F.col("t") == "1", F.col("p") == "1", F.col("n")
    zero = F.lit(0)
    return counts.groupBy(*keys).agg(
        F.sum(F.when(t & p, n).otherwise(zero)).alias("tp"),
        F.sum(F.when(~t & p, n).otherwise(zero)).alias("fp"),
        F.sum(F.when(t & ~p, n).otherwise(zero)).alias("fn"),
        F.sum(F.when(t == p, n).otherwise(zero)).alias("right_n"),
        F.sum(n).alias("total"),
    )


def _prf(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({
        "precision": X.safe_div(tp, tp + fp),
        "recall": X.safe_div(tp, tp + fn),
        "f1": X.safe_div(2 * tp, 2 * tp + fp + fn),
    })


def _macro(per_label: DataFrame, names: dict[str, str]) -> DataFrame:
    """Unweighted means over labels, summed in label order so that the result
    does not depend on task order."""
    rows = F.array_sort(F.collect_list(F.struct("label", *names)))
    def mean(column: str) -> Column:
        total = F.aggregate("rows", F.lit(0.0), lambda acc, r: acc + r[column])
        return X.safe_div(total, F.size("rows"))
    return per_label.groupBy("field").agg(rows.alias("rows")).select(
        "field", *[mean(column).alias(out) for column, out in names.items()])


def _long(df: DataFrame, names: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]
    return df.select("field", F.inline(F.array(*cells)))


PRF = ("accuracy", "precision", "recall", "f1")
SET_METRICS = (*PRF, "micro_f1", "macro_f1", "macro_precision", "macro_recall")


def binary_metrics(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 of 0/1 fields; 0 for empty denominators."""
    scored = _prf(_tp_fp_fn(counts.filter(F.col("kind") == "binary"), "field"))
    return _long(scored.withColumn("accuracy", X.safe_div(F.col("right_n"), F.col("total"))), PRF)


def class_label_scores(counts: DataFrame) -> DataFrame:
    """Per-label tp/fp/fn and scores, for labels seen in truth or prediction."""
    part = counts.filter(F.col("kind") == "class")
    side = F.array(
        F.struct(F.col("t").alias("label"), F.lit("t").alias("side")),
        F.struct(F.col("p").alias("label"), F.lit("p").alias("side")),
    )
    long = part.select("field", "n", (F.col("t") == F.col("p")).alias("same"), F.inline(side))
    n, same = F.col("n"), F.col("same")
    sums = long.groupBy("field", "label").agg(
        F.sum(F.when((F.col("side") == "t") & same, n).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("side") == "p") & ~same, n).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("side") == "t") & ~same, n).otherwise(0)).alias("fn"),
    )
    return _prf(sums)


def class_metrics(counts: DataFrame) -> DataFrame:
    """accuracy and macro precision, recall, f1 of single-class fields."""
    part = counts.filter(F.col("kind") == "class")
    right = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    accuracy = part.groupBy("field").agg(X.safe_div(right, F.sum("n")).alias("accuracy"))
    macro = _macro(class_label_scores(counts), {"precision": "precision", "recall": "recall", "f1": "f1"})
    return _long(accuracy.join(macro, "field"), PRF)


def set_metrics(counts: DataFrame) -> DataFrame:
    """Subset accuracy, micro and macro scores of multi-label fields; macro
    means run over the whole label space."""
    part = counts.filter(F.col("kind") == "set")
    micro = _prf(_tp_fp_fn(part, "field"))
    per_label = _prf(_tp_fp_fn(part, "field", "label"))
    macro = _macro(per_label, {"f1": "macro_f1", "precision": "macro_precision", "recall": "macro_recall"})
    subset = counts.filter(F.col("kind") == "subset").groupBy("field").agg(
        X.safe_div(F.sum(F.when(F.col("p") == "1", F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    joined = micro.withColumn("micro_f1", F.col("f1")).join(macro, "field").join(subset, "field")
    return _long(joined, SET_METRICS)


def evaluate(frame: DataFrame, fields: EvalFields) -> DataFrame:
    """All metrics of all fields as a long table (field, metric, value)."""
    counts = outcome_counts(frame, fields)
    parts = []
    if fields.binary:
        parts.append(binary_metrics(counts))
    if fields.sets:
        parts.append(set_metrics(counts))
    if fields.classes:
        parts.append(class_metrics(counts))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def confusion(frame: DataFrame, name: str, labels: Sequence[str]) -> DataFrame:
    """Dense confusion counts over a label list: (true_label, pred_label, n)."""
    counts = frame.groupBy(
        F.col(f"true_{name}").cast("string").alias("true_label"), F.col(f"pred_{name}").cast("string").alias("pred_label"),
    ).agg(F.count(F.lit(1)).alias("n"))
    grid = dim(frame.sparkSession, [(t, p) for t in labels for p in labels], "true_label string, pred_label string")
    return grid.join(counts, ["true_label", "pred_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def compare_metrics(model: DataFrame, rules: DataFrame, set_fields: Sequence[str], primary: str = "f1") -> DataFrame:
    """Which of two metric tables is better per field: micro_f1 for multi-label
    fields, else the primary metric."""
    wanted = F.when(F.col("field").isin(list(set_fields)), F.lit("micro_f1")).otherwise(F.lit(primary))
    pick = lambda df, name: df.filter(F.col("metric") == wanted).select("field", "metric", F.col("value").alias(name))
    joined = pick(model, "model").join(pick(rules, "rules"), ["field", "metric"])
    return joined.select(
        "field", "metric", "model", "rules",
        F.when(F.col("model") > F.col("rules"), F.lit("model"))
        .when(F.col("rules") > F.col("model"), F.lit("rules")).otherwise(F.lit("tie")).alias("winner"),
        (F.col("model") - F.col("rules")).alias("delta"),
    )


# --- routing decisions -------------------------------------------------------

DECISIONS = ("correct", "over", "under", "mixed")


def add_decision(frame: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Decision class of the flag vector: correct, over, under or mixed."""
    true = F.array(*[F.col(f"true_{c}").cast("int") for c in flags])
    pred = F.array(*[F.col(f"pred_{c}").cast("int") for c in flags])
    delta = F.zip_with(pred, true, lambda p, t: p - t)
    over = F.exists("__delta", lambda d: d > 0)
    under = F.exists("__delta", lambda d: d < 0)
    decision = (
        F.when(over & under, F.lit("mixed")).when(over, F.lit("over")).when(under, F.lit("under"))
        .otherwise(F.lit("correct"))
    )
    return frame.withColumn("__delta", delta).withColumn("decision", decision).drop("__delta")


def decision_rates(decided: DataFrame) -> DataFrame:
    """One row of overall rates; all 0 without rows."""
    total = F.count(F.lit(1))
    rate = lambda d: X.ratio(F.count_if(F.col("decision") == d), total)
    return decided.agg(
        rate("correct").alias("exact_match_rate"), rate("over").alias("over_trigger_rate"),
        rate("under").alias("under_trigger_rate"), rate("mixed").alias("mixed_error_rate"),
    )


def decision_breakdown(decided: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Decision counts and rates per group value.  A group column is a
    list without empty rows (see ``default_list``), so totals can exceed the rows."""
    def entry(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("group_name"), v.alias("group_key")))

    entries = [entry(name, values) for name, values in groups.items()]
    listed = F.concat(*entries) if len(entries) > 1 else entries[0]
    counted = decided.select("decision", F.inline(listed)).groupBy("group_name", "group_key").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS],
    )
    return counted.withColumns({f"{d}_rate": X.ratio(F.col(d), F.col("total")) for d in DECISIONS})


def worst_groups(breakdown: DataFrame, k: int = 8) -> DataFrame:
    """Groups with the lowest correct rate, smaller groups first."""
    order = [F.col("correct_rate"), F.col("total"), F.col("group_key")]
    return top_k(breakdown, ["group_name"], order, k, "position")


# --- errors ------------------------------------------------------------------

def error_records(frame: DataFrame, fields: EvalFields, keep: Sequence[str], ordered: bool = False) -> DataFrame:
    """One row per wrong field: (keep..., label_pos, label, error_type,
    true_value, pred_value).  Sets are compared as sets unless ``ordered``."""
    def record(pos: int, name: str, wrong: Column, kind: Column, t: Column, p: Column) -> Column:
        return F.when(wrong, F.struct(
            F.lit(pos).alias("label_pos"), F.lit(name).alias("label"), kind.alias("error_type"),
            t.alias("true_value"), p.alias("pred_value")))

    cells = []
    for name in fields.binary:
        t, p = F.col(f"true_{name}").cast("int"), F.col(f"pred_{name}").cast("int")
        kind = F.when(p > t, F.lit("false_positive")).otherwise(F.lit("false_negative"))
        cells.append(record(len(cells), name, ~t.eqNullSafe(p), kind, t.cast("string"), p.cast("string")))
    for name in fields.classes:
        t, p = F.col(f"true_{name}"), F.col(f"pred_{name}")
        cells.append(record(len(cells), name, ~t.eqNullSafe(p), F.lit("mismatch"), t, p))
    for name in fields.sets:
        t, p = F.col(f"true_{name}"), F.col(f"pred_{name}")
        wrong = X.lists_differ(t, p, ordered)
        cells.append(record(len(cells), name, wrong, F.lit("set_mismatch"), X.join_list(t), X.join_list(p)))
    return frame.select(*keep, F.inline(F.array_compact(F.array(*cells))))


def error_counts(errors: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Errors per label and per group value: (group_name, group_key, n)."""
    cells = [F.struct(F.lit(name).alias("group_name"), value.cast("string").alias("group_key"))
             for name, value in groups.items()]
    return errors.select(F.inline(F.array(*cells))).groupBy("group_name", "group_key").agg(F.count(F.lit(1)).alias("n"))


def hotspots(counts: DataFrame, k: int = 20) -> DataFrame:
    """Groups with most errors, per group name."""
    return top_k(counts, ["group_name"], [F.desc("n"), F.col("group_key")], k, "position")


def error_examples(errors: DataFrame, order: Sequence[Column], limits: dict[str, int]) -> DataFrame:
    """First errors in record order: ``all`` and per error type, with own limits."""
    lists = F.array_compact(F.array(*[
        F.lit(name) if name == "all" else F.when(F.col("error_type") == name, F.lit(name)) for name in limits
    ]))
    listed = errors.withColumn("list_name", F.explode(lists))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("list_name"))
    ranked = top_k(listed, ["list_name"], order, max(limits.values()), "position")
    return ranked.filter(F.col("position") <= limit)


# --- expectation cases ---------------------------------------------------------

def check_expectations(cases: DataFrame, predictions: DataFrame, scalars: Sequence[str], lists: Sequence[str],
                       key: str = "name") -> DataFrame:
    """Named cases against predictions on the same key.  Expected columns are
    ``exp_<field>``, null when not checked; lists pass when contained.  A case
    without a prediction fails all that it checks."""
    joined = cases.join(predictions, key, "left")
    checks = [F.when(F.col(f"exp_{c}").isNotNull(), F.coalesce(F.col(c).eqNullSafe(F.col(f"exp_{c}")), F.lit(False)))
              for c in scalars]
    checks += [F.when(F.col(f"exp_{c}").isNotNull(), F.coalesce(X.contains_all(F.col(c), F.col(f"exp_{c}")), F.lit(False))) for c in lists]
    names = [*scalars, *lists]
    marked = joined.select(key, *[check.alias(f"ok_{name}") for name, check in zip(names, checks)])
    passed = F.forall(F.array(*[F.col(f"ok_{name}") for name in names]), lambda ok: F.coalesce(ok, F.lit(True)))
    return marked.withColumn("all_passed", passed)


def expectation_summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("all_passed").alias("passed"), F.count(F.lit(1)).alias("total"))
