"""Raw JSON lines made of the events: quarantine, keys and types by a label spec, nested items."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelmill.config import LabelSpec
from labelmill.operators import validate as V

#: A corpus of payments: what happened is the text, whether it is a purchase the domain.
SPEC = LabelSpec(domain="paid", flags=("big",), crops=("a",), topics=("t",), intents=("x",), urgencies=("y",))

#: Some of the texts are broken by a rule that both engines read.
BROKEN = """CASE event_id % 9 WHEN 0 THEN left(props, length(props) - 1) WHEN 1 THEN ' ' WHEN 2 THEN concat('[', props, ']')
 WHEN 3 THEN concat('{"k": 0, ', substr(props, 2)) WHEN 4 THEN 'null' ELSE props END"""

LINE = """concat('{"id": "e', event_id, '", "input": "', event_type, '", "labels": {"paid": ', CASE WHEN event_type = 'purchase' THEN 'true' ELSE 'false' END,
 CASE event_id % 5 WHEN 0 THEN ', "big": true' WHEN 1 THEN ', "big": false' WHEN 2 THEN ', "big": "true"' WHEN 3 THEN ', "big": null' ELSE '' END,
 ', "crops": ', CASE event_id % 3 WHEN 0 THEN '["a"]' WHEN 1 THEN '[]' ELSE '["a", 5, [true]]' END, ', "topics": [], "intent": "x", "urgency": "y"}, "meta": {"source_type": "s", "notes": ',
 CASE event_id % 4 WHEN 0 THEN '7' ELSE '"n"' END, ', "difficulty": "simple"}', CASE event_id % 7 WHEN 0 THEN ', "more": 1' ELSE '' END, '}')"""

ITEMS = """concat('{"rows": [', props, ', {"k": "', event_type, '"}', CASE event_id % 3 WHEN 0 THEN concat(', {"z": 1, "k": "', event_type, '"}, {"k": "', event_type, '", "z": 1}')
 WHEN 1 THEN ', "loose"' ELSE '' END, '], "tags": [["', event_type, '"], [', event_id % 4, ']]}')"""

NESTED = {
    "type": "object",
    "properties": {
        "rows": {"type": "array", "uniqueItems": True, "items": {
            "type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "string", "enum": ["view", "click", "signup"]}}}},
        "tags": {"type": "array", "items": {"type": "array", "items": {"type": "string", "minLength": 6}}},
    },
}


def _lines(spark, sf, text):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.expr(text).alias("value"))


def quarantined_lines(spark, sf):
    """All lines that are not blank: readable ones with their value, the others with a reason."""
    readable, rejected = V.split_lines(_lines(spark, sf, BROKEN))
    read = readable.select("event_id", F.from_json("value", "k bigint")["k"].alias("k"), F.lit(None).cast("string").alias("reason"))
    return read.unionByName(rejected.select("event_id", F.lit(None).cast("bigint").alias("k"), "reason"))


def spec_violations(spark, sf):
    return V.validate_lines(_lines(spark, sf, LINE), V.spec_schema(SPEC), ["event_id"])


def item_violations(spark, sf):
    return V.validate_lines(_lines(spark, sf, ITEMS), NESTED, ["event_id"])


QUERIES = {f.__name__: f for f in (quarantined_lines, spec_violations, item_violations)}

_TYPE = "CASE {0} WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'BOOLEAN' THEN 'BOOLEAN' END"

ORACLE = {
    "quarantined_lines": f"""
        WITH lines AS (
            SELECT event_id, {BROKEN} AS value FROM events
        ), judged AS (
            SELECT event_id, value, CASE WHEN NOT json_valid(value) THEN 'bad_json' WHEN json_type(value) <> 'OBJECT' THEN 'not_an_object'
                   WHEN value LIKE '%"k"%"k"%' THEN 'repeated_key' END AS reason
            FROM lines WHERE trim(value) <> ''
        )
        SELECT event_id, CASE WHEN reason IS NULL THEN CAST(json_extract(value, '$.k') AS BIGINT) END AS k, reason FROM judged""",
    "spec_violations": f"""
        WITH lines AS (
            SELECT event_id, {LINE} AS value FROM events
        ), typed AS (
            SELECT event_id, json_exists(value, '$.labels.big') AS has_big, json_type(value, '$.labels.big') AS big, json_type(value, '$.meta.notes') AS notes,
                   list_filter(json_keys(value), lambda k: k NOT IN ('id', 'input', 'labels', 'meta')) AS extra,
                   json_extract(value, '$.labels.crops[*]') AS crops FROM lines
        ), items AS (
            SELECT event_id, unnest(crops) AS item, generate_subscripts(crops, 1) - 1 AS i FROM typed
        )
        SELECT event_id, '$.labels: missing keys' AS rule, 'big' AS detail FROM typed WHERE NOT has_big
        UNION ALL SELECT event_id, '$.labels.big: not boolean', {_TYPE.format("big")} FROM typed WHERE has_big AND big <> 'BOOLEAN'
        UNION ALL SELECT event_id, '$.meta.notes: not string', {_TYPE.format("notes")} FROM typed WHERE notes <> 'VARCHAR'
        UNION ALL SELECT event_id, '$: extra keys', array_to_string(list_sort(extra), ', ') FROM typed WHERE len(extra) > 0
        UNION ALL SELECT event_id, '$.labels.crops[]: not string', '$.labels.crops[' || i || ']: ' || CASE json_type(item) WHEN 'ARRAY' THEN 'ARRAY<BOOLEAN>' ELSE {_TYPE.format("json_type(item)")} END
        FROM items WHERE json_type(item) <> 'VARCHAR'""",
    "item_violations": f"""
        WITH lines AS (
            SELECT event_id, {ITEMS} AS value FROM events
        ), rows AS (
            SELECT event_id, unnest(json_extract(value, '$.rows[*]')) AS item, generate_subscripts(json_extract(value, '$.rows[*]'), 1) - 1 AS i FROM lines
        ), tags AS (
            SELECT event_id, '$.tags[' || a || '][0]' AS place, json_extract(value, '$.tags[' || a || '][0]') AS item FROM lines, (VALUES (0), (1)) AS t(a)
        ), fields AS (
            SELECT *, '$.rows[' || i || ']' AS place, CASE WHEN json_type(item) = 'OBJECT' THEN json_type(item, '$.k') END AS kind, json_extract_string(item, '$.k') AS k FROM rows
        )
        SELECT event_id, '$.rows: repeated items' AS rule, NULL AS detail FROM fields WHERE kind IS NOT NULL
        GROUP BY event_id HAVING count(*) > count(DISTINCT k || ':' || coalesce(json_extract_string(item, '$.z'), ''))
        UNION ALL SELECT event_id, '$.rows[]: not object', place || ': STRING' FROM fields WHERE json_type(item) <> 'OBJECT'
        UNION ALL SELECT event_id, '$.rows[]: extra keys', place || ': z' FROM fields WHERE json_exists(item, '$.z')
        UNION ALL SELECT event_id, '$.rows[].k: not string', place || '.k: BIGINT' FROM fields WHERE kind <> 'VARCHAR'
        UNION ALL SELECT event_id, '$.rows[].k: not in enum', place || '.k: ' || k FROM fields WHERE kind = 'VARCHAR' AND k NOT IN ('view', 'click', 'signup')
        UNION ALL SELECT event_id, '$.tags[][]: not string', place || ': BIGINT' FROM tags WHERE json_type(item) <> 'VARCHAR'
        UNION ALL SELECT event_id, '$.tags[][]: too short', place || ': ' || json_extract_string(item, '$') FROM tags
        WHERE json_type(item) = 'VARCHAR' AND length(json_extract_string(item, '$')) < 6""",
}
