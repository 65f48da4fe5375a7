"""What users of a corpus see row by row: confidences, log events, broken records, report warnings, cached vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators import logodds as H
from labelmill.operators import profile as P
from labelmill.operators import route as R
from labelmill.operators import validate as V
from labelmill.operators.corpus import label_names
from labelmill.operators.scale import run_dir
from labelmill.plans import bindings as B
from labelmill.plans import corpus_queries as C
from labelmill.plans import model_queries as M
from labelmill.plans import sqltext as S
from labelmill.sources import vector_cache as VC

ID = "doc_[0-9]{3}"
AT = "2025-01-01T00:00:00.000000+00:00"

#: Broken records by a rule that both engines read: (column, DuckDB text, Spark text).
BROKEN = (
    ("crops", "CASE doc_id % 7 WHEN 0 THEN list_concat(crops, ['latin', 'latin']) WHEN 1 THEN list_concat(crops, ['celtic']) WHEN 2 THEN ['both', 'latin'] WHEN 3 THEN CAST([] AS VARCHAR[]) ELSE crops END",
     "CASE doc_id % 7 WHEN 0 THEN concat(crops, array('latin', 'latin')) WHEN 1 THEN concat(crops, array('celtic')) WHEN 2 THEN array('both', 'latin') WHEN 3 THEN CAST(array() AS array<string>) ELSE crops END"),
    ("topics", "CASE doc_id % 5 WHEN 0 THEN list_concat(topics, ['tax', 'tax']) WHEN 1 THEN CAST([] AS VARCHAR[]) ELSE topics END",
     "CASE doc_id % 5 WHEN 0 THEN concat(topics, array('tax', 'tax')) WHEN 1 THEN CAST(array() AS array<string>) ELSE topics END"),
    ("intent", *["CASE doc_id % 11 WHEN 0 THEN 'chat' WHEN 1 THEN NULL ELSE intent END"] * 2),
    ("urgency", *["CASE doc_id % 13 WHEN 0 THEN 'now' ELSE urgency END"] * 2),
    ("thermal", *["CASE doc_id % 17 WHEN 0 THEN true ELSE thermal END"] * 2),
    ("id", *["CASE doc_id % 9 WHEN 0 THEN concat('doc_', lpad(CAST(doc_id % 90 AS VARCHAR(9)), 3, '0')) ELSE concat('doc_', CAST(doc_id AS VARCHAR(9))) END"] * 2),
    ("difficulty", *["CASE doc_id % 6 WHEN 0 THEN 'extreme' ELSE 'hard' END"] * 2),
    ("source_type", *["CASE doc_id % 8 WHEN 0 THEN source ELSE 'synthetic' END"] * 2),
    ("notes", *["CASE doc_id % 10 WHEN 0 THEN '  ' ELSE lang END"] * 2),
    ("input", *["CASE doc_id % 4 WHEN 0 THEN left(text, 9) ELSE text END"] * 2),
)


def records(spark, sf):
    """Rule predictions of all documents as a corpus, in which some records are broken."""
    ruled = B.ruled(spark, sf).withColumn("split", F.when(F.col("doc_id") % 3 == 0, "train").otherwise("val"))
    placed = ruled.withColumns({"split_pos": F.when(F.col("split") == "train", 1).otherwise(2), "line_no": F.col("doc_id")})
    return placed.withColumns({name: F.expr(text) for name, _, text in BROKEN})


def routed(spark, sf):
    scorer = H.compile_model(H.fit(B.training(spark, sf), B.spec_heads(), "text"))
    texts, _ = R.split_blank(B.documents(spark, sf).select("doc_id", "text"), "text")
    return R.route(texts, scorer, B.RULES, "text")


def _scores(name):
    return F.transform(F.map_entries(f"conf_{name}"), lambda e: F.struct(F.lit(name).alias("field"), e["key"].alias("label"), e["value"].alias("score")))


def route_confidence(spark, sf):
    """Every confidence of every routed document: (doc_id, field, label, score)."""
    flags = [F.struct(F.lit(n).alias("field"), F.lit("true").alias("label"), F.col(f"conf_{n}").alias("score")) for n in B.SPEC.binary]
    maps = [_scores(n) for n in (*B.SPEC.sets, *B.SPEC.classes)]
    return routed(spark, sf).select("doc_id", F.inline(F.concat(F.array(*flags), *maps)))


def route_events(spark, sf):
    """Routed documents as log events with given ids and time; labels as JSON, empty fields told."""
    number = X.build_id(F.col("doc_id"), "event_", 8)
    events = R.to_events(routed(spark, sf), B.RULES, "text", number, F.lit(AT))
    empty = [F.col(c).isNull() for c in ("user_feedback", "corrected_labels", "review_notes")]
    return events.select("id", "interaction_id", "entry_type", "timestamp", F.md5("input").alias("input_key"), F.to_json("prediction").alias("prediction"),
                         F.col("confidence.in_scope").alias("in_scope_score"), (empty[0] & empty[1] & empty[2]).alias("unreviewed"))


def list_rules(spark, sf):
    """What rules of one row find in the broken records."""
    return V.violations(records(spark, sf), V.corpus_rules(B.SPEC, ID), ["split", "line_no"])


def _again(spark, sf, *names):
    found = V.validate_corpus(records(spark, sf), B.SPEC, keep=("split", "line_no"), id_pattern=ID)
    return found.filter(F.col("rule").isin(*names))


def repeated_ids(spark, sf):
    """Second and later records of an id, in the order of splits and lines."""
    return _again(spark, sf, "repeated_id")


def signatures(spark, sf):
    """Second and later records of an input, and of an input with the same labels and notes."""
    return _again(spark, sf, "repeated_input", "repeated_signature")


def report_warnings(spark, sf):
    """What a report warns of; nothing fails for it."""
    rows = C.marks(spark, sf)
    checks = P.distribution_gate(C.stats(rows), C.BANDS, P.combo_minimums(rows, B.FLAGS, C.COMBOS), "warn")
    return checks.filter(F.col("severity") == "warn").select("check", "value", "lo", "hi", "status", "severity")


def label_vectors(spark, sf):
    """Labels of list and class fields as strings, and the notes with a small first letter."""
    rows = records(spark, sf)
    cells = [F.struct(F.lit(n).alias("field"), X.label_vector(F.col(n), n in B.SPEC.sets).alias("labels")) for n in ("crops", "topics", "intent", "urgency", "thermal")]
    return rows.select("doc_id", X.lower_first(F.concat(F.upper("lang"), F.lit(" "), F.left("text", F.lit(20)))).alias("opening"), F.inline(F.array(*cells))) \
        .select("doc_id", "opening", "field", X.join_list(F.col("labels")).alias("labels"))


def cached_vectors(spark, sf):
    """Vectors of all turns through a cache that a run over the users' turns has filled."""
    turns = B.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")

    def shape(text):
        return F.array(F.length(text), F.length(F.replace(text, F.lit(" "), F.lit(""))), F.length(F.replace(text, F.lit("e"), F.lit("")))).cast("array<double>")

    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    VC.embed_cached(turns.filter(F.col("role") == "user"), VC.open_cache(spark, path, "shape", 8), shape, "text")
    cache = VC.compact(spark, path)
    rows = VC.embed_cached(turns, cache, shape, "text")
    return rows.select("conv_id", "turn", *[F.get("embedding", F.lit(i)).alias(f"v{i}") for i in range(3)], "was_cached")


QUERIES = {f.__name__: f for f in (
    route_confidence, route_events, list_rules, repeated_ids, signatures, report_warnings, label_vectors, cached_vectors)}

# --- the same in SQL ---------------------------------------------------------------

_ROUTED = f"WITH {S.rules_cte()}, {M._fit_ctes(M._SPEC)}, {M._SCORES}, {M._MODEL}"
_BLANK = f"{S.strip('text')} <> ''"
_FLAG_CASES = " ".join(f"WHEN field = '{f}' THEN CASE WHEN in_scope AND {f} THEN greatest(s, 0.80::DOUBLE) WHEN in_scope THEN s ELSE least(s, 0.20::DOUBLE) END" for f in B.FLAGS)
_CONF = f"""conf AS (SELECT doc_id, field, label, CASE
 WHEN field = 'in_scope' THEN CASE WHEN in_scope THEN greatest(s, 0.85::DOUBLE) ELSE least(s, 0.20::DOUBLE) END {_FLAG_CASES}
 WHEN field = 'crops' AND in_scope AND list_contains(crops, label) THEN greatest(s, 0.82::DOUBLE)
 WHEN field = 'topics' AND in_scope AND list_contains(topics, label) THEN greatest(s, 0.78::DOUBLE)
 WHEN field = 'intent' AND in_scope AND intent <> 'other' AND intent = label THEN greatest(s, 0.72::DOUBLE)
 WHEN field = 'urgency' AND in_scope AND urgency = label THEN greatest(s, 0.72::DOUBLE) ELSE s END AS score
 FROM (SELECT doc_id, field, label, round(p, 4) AS s FROM prob) JOIN r USING (doc_id) WHERE {_BLANK})"""
_PREDICTED = {
    "in_scope": "in_scope", "crops": "CASE WHEN in_scope THEN crops ELSE CAST([] AS VARCHAR[]) END",
    "topics": f"CASE WHEN in_scope THEN list_sort(list_distinct(list_concat({M._MT}, topics))) ELSE CAST([] AS VARCHAR[]) END",
    **{f: f"in_scope AND (m_{f} OR {f})" for f in B.FLAGS},
    "intent": "CASE WHEN in_scope AND intent <> 'other' THEN intent ELSE m_intent END", "urgency": "CASE WHEN in_scope THEN urgency ELSE 'low' END",
}
_STRUCT = ", ".join(f"{n} := {_PREDICTED[n]}" for n in label_names(B.SPEC))

_RECORDS = f"""WITH {S.rules_cte()}, rec AS (SELECT * REPLACE ({', '.join(f'{sql} AS {name}' for name, sql, _ in BROKEN if name in ('crops', 'topics', 'intent', 'urgency', 'thermal'))}),
 {', '.join(f'{sql} AS {name}' for name, sql, _ in BROKEN if name not in ('crops', 'topics', 'intent', 'urgency', 'thermal'))},
 CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'val' END AS split, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS split_pos, doc_id AS line_no FROM r)"""


def _in(column: str, values) -> str:
    return f"coalesce({column} IN ({', '.join(S.quoted(v) for v in values)}), false)"


def _outside(column: str, values) -> str:
    """Distinct labels that the space lacks, in order of their first place."""
    lacking = f"list_filter({column}, lambda x: NOT list_contains([{', '.join(S.quoted(v) for v in values)}], x))"
    return f"list_filter({lacking}, lambda x, i: list_position({lacking}, x) = i)"


def _rule(name: str, broken: str, detail: str = "NULL") -> str:
    return f"SELECT split, line_no, '{name}' AS rule, CAST({detail} AS VARCHAR) AS detail FROM rec WHERE {broken}"


_RULES = [
    _rule("bad_id", f"NOT regexp_full_match(id, '{ID}')", "id"), _rule("blank_input", f"{S.strip('input')} = ''"),
    _rule("repeated_crop", "len(list_distinct(crops)) <> len(crops)", M._JOIN("crops")), _rule("repeated_topic", "len(list_distinct(topics)) <> len(topics)", M._JOIN("topics")),
    _rule("unknown_crop", f"len({_outside('crops', B.SPEC.crops)}) > 0", M._JOIN(_outside("crops", B.SPEC.crops))),
    _rule("unknown_topic", f"len({_outside('topics', B.SPEC.topics)}) > 0", M._JOIN(_outside("topics", B.SPEC.topics))),
    *[_rule(f"unknown_{name}", f"NOT {_in(name, space)}", name) for name, space in (
        ("intent", B.SPEC.intents), ("urgency", B.SPEC.urgencies), ("difficulty", B.SPEC.difficulties), ("source_type", B.SPEC.source_types))],
    _rule("blank_notes", f"{S.strip('notes')} = ''"),
    *[_rule(f"domain_without_{name}", f"in_scope AND len({name}s) = 0") for name in ("crop", "topic")],
    *[_rule(f"outside_with_{name}", f"NOT in_scope AND len({name}s) > 0") for name in ("crop", "topic")],
    *[_rule(f"{label}_not_alone", f"list_contains(crops, '{label}') AND len(crops) > 1", M._JOIN("crops")) for label in B.SPEC.exclusive_crops],
    *[_rule(f"outside_with_{flag}", f"NOT in_scope AND {flag}") for flag in B.FLAGS],
]


def _repeats(rule: str, key: str, where: str = "true") -> str:
    order = f"OVER (PARTITION BY {key} ORDER BY split_pos, line_no)"
    return f"""SELECT split, line_no, '{rule}' AS rule, detail FROM (SELECT split, line_no, row_number() {order} AS n,
 first_value(split_pos || ':' || line_no) {order} AS detail FROM rec WHERE {where}) WHERE n > 1"""


_LABELS = ", ".join(["in_scope", "crops", "topics", *B.FLAGS, "intent", "urgency", "notes"])
_HAS_INPUT = f"{S.strip('input')} <> '' AND {S.norm('input')} IS NOT NULL"
_FIELDS = {**{n: M._JOIN(n) for n in B.SPEC.sets}, **{n: f"coalesce(CAST({n} AS VARCHAR), 'none')" for n in ("intent", "urgency", "thermal")}}

ORACLE = {
    "route_confidence": f"{_ROUTED}, {_CONF} SELECT doc_id, field, label, score FROM conf",
    "route_events": f"""{_ROUTED}, {_CONF}
SELECT 'event_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(len(CAST(doc_id AS VARCHAR)), 8) AS INT), '0') AS id, id AS interaction_id, 'inference' AS entry_type,
 '{AT}' AS timestamp, md5({S.strip('text')}) AS input_key, CAST(to_json(struct_pack({_STRUCT})) AS VARCHAR) AS prediction, score AS in_scope_score, true AS unreviewed
FROM r JOIN model USING (doc_id) JOIN (SELECT doc_id, score FROM conf WHERE field = 'in_scope') USING (doc_id)""",
    "list_rules": f"{_RECORDS} {' UNION ALL '.join(_RULES)}",
    "repeated_ids": f"{_RECORDS} {_repeats('repeated_id', 'id')}",
    "signatures": f"""{_RECORDS} {_repeats('repeated_input', S.norm('input'), _HAS_INPUT)}
 UNION ALL {_repeats('repeated_signature', f"{S.norm('input')}, {_LABELS}", _HAS_INPUT)}""",
    "report_warnings": C.ORACLE["distribution_gate"].replace("ELSE 'fail' END", "ELSE 'warn' END") + " WHERE status <> 'ok'",
    "label_vectors": f"""{_RECORDS}, opened AS (SELECT *, upper(lang) || ' ' || left(text, 20) AS raw FROM rec) """ + " UNION ALL ".join(
        f"SELECT doc_id, lower(left(raw, 1)) || substr(raw, 2) AS opening, '{n}' AS field, {sql} AS labels FROM opened" for n, sql in _FIELDS.items()),
    "cached_vectors": """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations)
SELECT conv_id, turn, CAST(length(x) AS DOUBLE) AS v0, CAST(length(replace(x, ' ', '')) AS DOUBLE) AS v1, CAST(length(replace(x, 'e', '')) AS DOUBLE) AS v2,
 x IN (SELECT x FROM t WHERE role = 'user') AS was_cached FROM t""",
}
