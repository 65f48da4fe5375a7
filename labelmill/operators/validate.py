"""Corpus validation: every broken rule becomes a row of a violations table.

Row rules are boolean expressions evaluated in one narrow pass.  Uniqueness
rules aggregate their keys first (map-side combine) and join back with hot keys
kept out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.config import LabelSpec
from labelmill.functions import text as X
from labelmill.operators.scale import HOT_ROWS, cut_lineage, join_by_key

ID_PATTERN = "route_[0-9]{6}"


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for a violating row; null counts as not broken."""

    name: str
    broken: Column
    detail: Column | None = None


def violations(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., rule, detail), one per broken rule."""
    none = F.lit(None).cast("string")
    cells = [
        F.when(r.broken, F.struct(
            F.lit(r.name).alias("rule"), (none if r.detail is None else r.detail.cast("string")).alias("detail")))
        for r in rules
    ]
    return df.select(*keep, F.inline(F.array_compact(F.array(*cells))))


def repeated(df: DataFrame, keys: dict[str, Column], position: Sequence[str], keep: Sequence[str],
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Second and later rows of each key in ``position`` order, for several
    named keys; the detail is the first row's position.

    Rows without a key ('' or null) are left out.  Rows at the same position
    are told apart by a row number, so every repeat is found.  The keys are
    written once as a narrow table, because counting and joining would
    otherwise both read the texts again; one aggregate counts all named keys,
    and only those of several rows are joined back.
    """
    named = [F.coalesce(key.cast("string"), F.lit("")).alias(f"__k{i}") for i, key in enumerate(keys.values())]
    narrow = cut_lineage(df.select(*keep, F.struct(*position, F.monotonically_increasing_id().alias("__row")).alias("__at"), *named))
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"__k{i}").alias("key")) for i, name in enumerate(keys)])
    keyed = narrow.select(*keep, "__at", F.inline(cells)).filter(F.col("key") != "").withColumn("__key", F.struct("rule", "key")).drop("key")
    first = cut_lineage(
        keyed.groupBy("__key").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1))
    later = join_by_key(keyed, first, "__key", "__n", hot_rows).filter(F.col("__at") > F.col("__first"))
    where = F.concat_ws(":", *[F.col(f"__first.{p}").cast("string") for p in position])
    return later.select(*keep, "rule", where.alias("detail"))


def corpus_rules(spec: LabelSpec, id_pattern: str = ID_PATTERN, columns: Sequence[str] = ("source_type",)) -> list[Rule]:
    """Rules over a flat corpus frame that need only one row at a time.

    ``columns`` tells whether the frame has a ``source_type`` to check."""
    crops, topics, domain = F.col("crops"), F.col("topics"), F.col(spec.domain)
    rules = [
        Rule("bad_id", ~F.coalesce(X.full_match(F.col("id"), id_pattern), F.lit(False)), F.col("id")),
        Rule("blank_input", F.coalesce(X.strip(F.col("input")), F.lit("")) == ""),
        Rule("repeated_crop", F.size(F.array_distinct(crops)) != F.size(crops), X.join_list(crops)),
        Rule("unknown_crop", F.size(X.unknown_labels(crops, spec.crops)) > 0, X.join_list(X.unknown_labels(crops, spec.crops))),
        Rule("repeated_topic", F.size(F.array_distinct(topics)) != F.size(topics), X.join_list(topics)),
        Rule("unknown_topic", F.size(X.unknown_labels(topics, spec.topics)) > 0, X.join_list(X.unknown_labels(topics, spec.topics))),
        Rule("unknown_intent", ~F.coalesce(F.col("intent").isin(list(spec.intents)), F.lit(False)), F.col("intent")),
        Rule("unknown_urgency", ~F.coalesce(F.col("urgency").isin(list(spec.urgencies)), F.lit(False)), F.col("urgency")),
        Rule("unknown_difficulty", ~F.coalesce(F.col("difficulty").isin(list(spec.difficulties)), F.lit(False)), F.col("difficulty")),
        Rule("unknown_source_type", ~F.coalesce(F.col("source_type").isin(list(spec.source_types)), F.lit(False)), F.col("source_type")),
        Rule("blank_notes", F.coalesce(X.strip(F.col("notes")), F.lit("")) == ""),
        Rule("domain_without_crop", domain & (F.size(crops) == 0)),
        Rule("domain_without_topic", domain & (F.size(topics) == 0)),
        Rule("outside_with_crop", ~domain & (F.size(crops) > 0)),
        Rule("outside_with_topic", ~domain & (F.size(topics) > 0)),
    ]
    if "source_type" not in columns:
        rules = [r for r in rules if r.name != "unknown_source_type"]
    for label in spec.exclusive_crops:
        rules.append(Rule(f"{label}_not_alone", F.array_contains(crops, label) & (F.size(crops) > 1), X.join_list(crops)))
    for flag in spec.flags:
        rules.append(Rule(f"outside_with_{flag}", ~domain & F.col(flag)))
    return rules


def validate_corpus(df: DataFrame, spec: LabelSpec, position: Sequence[str] = ("split_pos", "line_no"),
                    keep: Sequence[str] = ("split", "line_no", "id"), id_pattern: str = ID_PATTERN,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """All violations of a flat corpus frame, uniqueness rules included."""
    blank = F.coalesce(X.strip(F.col("input")), F.lit("")) == ""
    norm = F.when(~blank, X.fingerprint(F.col("input")))
    labels = F.struct(spec.domain, "crops", "topics", *spec.flags, "intent", "urgency", "notes")
    signature = F.when(~blank, F.md5(F.concat_ws("\u0001", X.normalize_text(F.col("input")), F.to_json(labels))))
    out = violations(df, corpus_rules(spec, id_pattern, df.columns), keep)
    keys = {"repeated_id": F.col("id"), "repeated_input": norm, "repeated_signature": signature}
    return out.unionByName(repeated(df, keys, position, keep, hot_rows))


def raise_on_violation(found: DataFrame) -> None:
    """Raise with rule counts when a violations table is not empty."""
    counts = {r["rule"]: r["count"] for r in found.groupBy("rule").count().collect()}
    if counts:
        raise ValueError("corpus has violations: " + ", ".join(f"{k}={v}" for k, v in sorted(counts.items())))


# --- raw JSON lines --------------------------------------------------------------

_VARIANT = "variant"


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Add the parsed line as VARIANT ``doc``: null for text that is not JSON
    and for objects with repeated keys."""
    return lines.withColumn("doc", F.try_parse_json(line))


def line_rules(line: str = "value") -> list[Rule]:
    """Lines that cannot be read as one JSON object with distinct keys."""
    blank = X.strip(F.col(line)) == ""
    keys = F.json_object_keys(F.col(line))
    repeated_keys = F.size(F.array_distinct(keys)) != F.size(keys)
    unreadable = F.col("doc").isNull()
    return [
        Rule("blank_line", blank),
        Rule("repeated_key", ~blank & unreadable & F.coalesce(repeated_keys, F.lit(False))),
        Rule("bad_json", ~blank & unreadable & ~F.coalesce(repeated_keys, F.lit(False))),
        Rule("not_an_object", ~F.schema_of_variant("doc").startswith("OBJECT")),
    ]


def _type_of(value: Column) -> Column:
    """Variant type name; null where the value is absent."""
    return F.schema_of_variant(value)


_TYPES = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN"}


def _cells(cells: Sequence[tuple[str, Column, Column]], at: Column | None = None) -> Column:
    """Array of (rule, detail) structs of the broken ones of (rule, broken, shown); details of items begin with their place."""
    def detail(shown: Column) -> Column:
        return shown.cast("string") if at is None else F.concat_ws(": ", at, shown.cast("string"))

    return F.array_compact(F.array(*[
        F.when(broken, F.struct(F.lit(rule).alias("rule"), detail(shown).alias("detail"))) for rule, broken, shown in cells]))


def _child(value: Column, name: str) -> Column:
    quote = "\"" if "'" in name else "'"
    if quote in name:
        raise ValueError(f"property {name!r}: a name with both kinds of quotes has no path")
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", _VARIANT)


def schema_cells(schema: dict, value: Column, path: str = "$", at: Column | None = None) -> Column:
    """What breaks a schema, as an array of (rule, detail) structs.

    Knows the JSON-Schema keywords type, required, additionalProperties,
    properties, uniqueItems, items, minLength, pattern and enum.  Items of an
    array are checked by the schema of items, whatever it holds, inside the row:
    rules name the place with ``[]``, details with the position, so that each bad
    item is a violation.  Tests are on VARIANT types, because casting would turn
    ``5`` into ``'5'`` and ``"true"`` into true.  Objects are compared without
    regard to the order of their keys.  Unsupported types raise here, before any
    job runs.
    """
    kind = schema.get("type")
    if kind not in _TYPES:
        raise ValueError(f"{path}: unsupported schema type {kind!r}")
    def below(step: Column) -> Column:
        return F.concat(F.lit(path) if at is None else at, step)

    is_kind = F.coalesce(_type_of(value).startswith(_TYPES[kind]), F.lit(False))
    cells = [(f"{path}: not {kind}", value.isNotNull() & ~is_kind, _type_of(value))]
    parts = []
    if kind == "object":
        # The text of a variant has its keys once and in order.
        keys = F.json_object_keys(F.when(is_kind, F.to_json(value)))
        known = schema.get("properties", {})
        missing = F.array_except(X.label_array(schema.get("required", [])), keys)
        cells.append((f"{path}: missing keys", F.size(missing) > 0, X.join_list(missing)))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(keys, X.label_array(list(known)))
            cells.append((f"{path}: extra keys", F.size(extra) > 0, X.join_list(F.array_sort(extra))))
        parts = [schema_cells(child, _child(value, name), f"{path}.{name}", None if at is None else below(F.lit(f".{name}"))) for name, child in known.items()]
    elif kind == "array":
        items = F.try_variant_get(value, "$", "array<variant>")
        if schema.get("uniqueItems"):
            shown = F.transform(items, lambda item: F.to_json(F.struct(item.alias("v"))))
            cells.append((f"{path}: repeated items", is_kind & (F.size(F.array_distinct(shown)) != F.size(shown)), F.lit(None)))
        if "items" in schema:
            found = F.transform(items, lambda item, i: schema_cells(schema["items"], item, f"{path}[]", below(F.concat(F.lit("["), i.cast("string"), F.lit("]")))))
            parts = [F.flatten(found)]
    elif kind == "string":
        text = F.try_variant_get(F.when(is_kind, value), "$", "string")
        cells += [(f"{path}: {name}", broken, text) for name, broken in _string_checks(schema, text)]
    none = F.array().cast("array<struct<rule:string,detail:string>>")
    return F.concat(_cells(cells, at), *[F.coalesce(part, none) for part in parts])


def _string_checks(schema: dict, text: Column) -> list[tuple[str, Column]]:
    checks = []
    if schema.get("minLength"):
        checks.append(("too short", F.length(text) < schema["minLength"]))
    if schema.get("pattern"):
        pattern = schema["pattern"].removeprefix("^").removesuffix("$")
        checks.append(("pattern", ~X.full_match(text, pattern)))
    if schema.get("enum"):
        checks.append(("not in enum", ~text.isin(list(schema["enum"]))))
    return checks


def _object(properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}


def spec_schema(spec: LabelSpec) -> dict:
    """The exact keys and types of a corpus line, from its label spec alone.

    Which values labels may have is left to :func:`corpus_rules`.
    """
    string, flag, strings = {"type": "string"}, {"type": "boolean"}, {"type": "array", "items": {"type": "string"}}
    labels = {spec.domain: flag, "crops": strings, "topics": strings, **dict.fromkeys(spec.flags, flag), "intent": string, "urgency": string}
    return _object({"id": string, "input": string, "labels": _object(labels), "meta": _object(dict.fromkeys(("source_type", "difficulty", "notes"), string))})


def validate_lines(lines: DataFrame, schema: dict, keep: Sequence[str], line: str = "value") -> DataFrame:
    """Violations of raw JSON lines against a schema, one pass, no shuffle."""
    parsed = parse_lines(lines, line)
    unreadable = _cells([(r.name, r.broken, F.lit(None)) for r in line_rules(line)])
    return parsed.select(*keep, F.inline(F.concat(unreadable, schema_cells(schema, F.col("doc")))))


def split_lines(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that are one JSON object with distinct keys, and the others with a ``reason``; blank lines are in neither.

    Nothing fails on a bad line, in a batch or in a stream, so both parts can be
    written on.
    """
    rules = [r for r in line_rules(line) if r.name != "blank_line"]
    reason = F.coalesce(*[F.when(r.broken, r.name) for r in rules])
    marked = parse_lines(lines.filter(X.strip(F.col(line)) != ""), line).withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("doc", "reason"), marked.filter(F.col("reason").isNotNull()).drop("doc")
