"""Text functions, validation, profiling and rule classification."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from labelmill.config import AUDIT_COMBO_SPARSE, Band
from labelmill.functions import text as X
from labelmill.operators import profile as P
from labelmill.operators import validate as V
from labelmill.operators.lexicon import keyword_hits, rule_predict
from labelmill.operators.scale import cut_lineage, dim
from labelmill.plans import bindings as B
from labelmill.plans import sqltext as S

COMBOS = (
    ("none", (False, False, False, False), 20),
    ("thermal_only", (False, False, True, False), 20),
    ("legal_only", (True, False, False, False), 20),
    ("thermal_inquiry", (False, False, True, True), 20),
    ("legal_contact", (True, True, False, False), 3),
    ("all", (True, True, True, True), 1),
)
BANDS = (
    Band("non_domain_ratio", 0.25, 0.35), Band("lead_flag_ratio", 0.10, 0.70), Band("short_ratio", 0.08),
    Band("vague_ratio", 0.04), Band("multi_topic_ratio", 0.20), Band("hard_rows", 100),
)
AUDIT = (
    Band("non_domain_ratio", 0.25, 0.35, "weak", "diluting"),
    Band("lead_flag_ratio", 0.05, 0.15, "underused", "overrepresented"),
    Band("short_ratio", 0.08, None, "underrepresented"),
    Band("vague_ratio", 0.08, None, "underrepresented"),
    Band("multi_topic_ratio", 0.18, None, "underrepresented"),
)
STATS = ("total", "domain_total", "short_rows", "vague_rows", "multi_topic_rows", "hard_rows", "lead_flag_rows")


def normalize_text(spark, sf):
    return B.documents(spark, sf).select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


def text_shape(spark, sf):
    return P.text_shape(B.documents(spark, sf), B.VAGUE, "text").select("doc_id", "words", "is_short", "is_vague")


def token_features(spark, sf):
    feats = X.add_features(B.documents(spark, sf).select("doc_id", "text"), "text")
    return feats.select("doc_id", F.size("features").alias("n_features"),
                        F.array_min("features").alias("first_feature"), F.array_max("features").alias("last_feature"))


def doc_rules():
    return [
        V.Rule("bad_length", F.col("n_chars") != F.length("text"), F.col("n_chars")),
        V.Rule("short_text", X.is_short(F.col("text"))),
        V.Rule("blank_text", X.strip(F.col("text")) == ""),
        V.Rule("unknown_lang", ~F.col("lang").isin("en", "fr", "de"), F.col("lang")),
        V.Rule("bad_source", ~X.full_match(F.col("source"), "src[0-9]"), F.col("source")),
        V.Rule("toxic_but_low_quality", (F.col("toxic") == 1) & (F.col("quality") == 0)),
    ]


def violations(spark, sf):
    rows = B.documents(spark, sf).join(B.table(spark, sf, "labels"), "doc_id", "left")
    found = V.violations(rows, doc_rules(), ["doc_id"])
    again = V.repeated(rows, {"repeated_text": X.fingerprint(F.col("text"))}, ["doc_id"], ["doc_id"])
    return found.unionByName(again)


def duplicate_groups(spark, sf):
    groups = P.duplicate_groups(B.documents(spark, sf), "text", ("doc_id",))
    return groups.select("norm_key", "n", F.col("first").alias("first_doc_id"))


def stats(rows, group=None):
    hard = F.col("n_chars") > B.HARD_CHARS
    return P.corpus_stats(rows, "in_scope", "thermal", B.VAGUE, "text", hard=hard, group=group)


def corpus_stats(spark, sf):
    return stats(B.ruled(spark, sf))


def marks(spark, sf):
    """Rules and text marks of all documents, read once for several checks."""
    return cut_lineage(P.text_marks(B.ruled(spark, sf), B.VAGUE, "text"))


def scalar_histogram(spark, sf):
    counts = P.histogram(B.documents(spark, sf), ["lang", "source"])
    total = B.documents(spark, sf).agg(F.count(F.lit(1)).alias("total"))
    return P.with_share(counts, total, "total")


def array_histogram(spark, sf):
    ruled = B.ruled(spark, sf)
    total = ruled.agg(F.count_if("in_scope").alias("domain_total"))
    return P.with_share(P.histogram(ruled, arrays=["topics", "crops"]), total, "domain_total")


def flag_histogram(spark, sf):
    space = dim(spark, [(f, v) for f in B.FLAGS for v in ("true", "false")], "field string, value string")
    return P.zero_fill(P.histogram(B.ruled(spark, sf), flags=B.FLAGS), space, ["field", "value"])


def combo_counts(spark, sf):
    return P.combo_counts(B.ruled(spark, sf), B.FLAGS)


def combo_minimums(spark, sf):
    return P.combo_minimums(B.ruled(spark, sf), B.FLAGS, COMBOS)


def label_coverage(spark, sf):
    ruled = B.ruled(spark, sf)
    total = ruled.agg(F.count_if("in_scope").alias("domain_total"))
    return P.label_coverage(ruled, "topics", (*B.SPEC.topics, "never_seen"), total)


def distribution_gate(spark, sf):
    rows = marks(spark, sf)
    checks = P.distribution_gate(stats(rows), BANDS, P.combo_minimums(rows, B.FLAGS, COMBOS))
    return checks.select("check", "value", "lo", "hi", "status", "severity")


def audit_findings(spark, sf):
    rows = marks(spark, sf)
    combos = P.combo_minimums(rows, B.FLAGS, COMBOS).select("combo", "n")
    topics = P.histogram(rows, arrays=["topics"]).select("value", "n")
    groups = P.duplicate_groups(rows, "text", ("doc_id",)).agg(F.count(F.lit(1)).alias("duplicate_groups"))
    return P.audit_findings(stats(rows), AUDIT, combos, topics, groups)


def audit_diff(spark, sf):
    half = F.when(F.length("source") == 4, "before").otherwise("after")
    rows = B.ruled(spark, sf).withColumn("snapshot", half)
    return P.audit_diff(stats(rows, "snapshot"), "snapshot", "before", "after", STATS)


def dataset_overview(spark, sf):
    return P.dataset_overview(B.ruled(spark, sf), B.SPEC)


def split_expectation(spark, sf):
    expected = [("en", 620), ("fr", 100), ("de", 129), ("it", 5)]
    return P.split_expectation(B.documents(spark, sf), expected, "lang")


def class_samples(spark, sf):
    classes = {lang: F.col("lang") == lang for lang in ("en", "fr", "de", "es")}
    classes |= {"outside": ~F.col("in_scope"), "hard": (F.col("n_chars") > B.HARD_CHARS) & F.col("in_scope")}
    picks = P.class_samples(B.ruled(spark, sf).select("doc_id", "lang", "in_scope", "n_chars"), classes, [F.col("doc_id")])
    return picks.select("class", "pick", "doc_id")


def module_activation(spark, sf):
    return P.module_activation(B.ruled(spark, sf), B.MODULES)


def lexicon_flags(spark, sf):
    return B.ruled(spark, sf).select("doc_id", *B.FLAGS)


def domain_flag(spark, sf):
    """Domain with and without negative hints."""
    plain = rule_predict(B.documents(spark, sf), replace(B.RULES, negative_hints=()), "text", "plain_")
    both = rule_predict(plain, B.RULES, "text")
    return both.select("doc_id", "plain_in_scope", "in_scope")


def crop_resolution(spark, sf):
    return B.ruled(spark, sf).select("doc_id", X.join_list(F.col("crops")).alias("crops"))


def topic_rules(spark, sf):
    return B.ruled(spark, sf).select("doc_id", X.join_list(F.col("topics")).alias("topics"))


def intent_rules(spark, sf):
    return B.ruled(spark, sf).select("doc_id", "intent")


def urgency_rules(spark, sf):
    return B.ruled(spark, sf).select("doc_id", "urgency")


def rule_predict_all(spark, sf):
    return B.ruled(spark, sf).select(
        "doc_id", "in_scope", *B.FLAGS, X.join_list(F.col("crops")).alias("crops"),
        X.join_list(F.col("topics")).alias("topics"), "intent", "urgency")


def multi_hot(spark, sf):
    """Topics as a 0/1 vector and back."""
    coded = B.ruled(spark, sf).select("doc_id", X.multi_hot(F.col("topics"), B.SPEC.topics).alias("v"))
    return coded.select("doc_id", F.array_join(F.transform("v", lambda x: x.cast("string")), "").alias("bits"),
                        X.join_list(X.decode_hot(F.col("v"), B.SPEC.topics)).alias("topics"))


def opening_hits(spark, sf):
    """In how many documents the first twelve characters of a document occur, for all of them and per source."""
    docs = B.documents(spark, sf)
    openings = docs.select(F.col("source").alias("label"), F.left(X.lowered(F.col("text")), F.lit(12)).alias("keyword")).distinct()
    return keyword_hits(docs, openings, "doc_id", "text").groupBy("label", "keyword").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {
    "normalize_text": normalize_text, "text_shape": text_shape, "token_features": token_features,
    "violations": violations, "duplicate_groups": duplicate_groups, "corpus_stats": corpus_stats,
    "scalar_histogram": scalar_histogram, "array_histogram": array_histogram, "flag_histogram": flag_histogram,
    "combo_counts": combo_counts, "combo_minimums": combo_minimums, "label_coverage": label_coverage,
    "distribution_gate": distribution_gate, "audit_findings": audit_findings, "audit_diff": audit_diff,
    "dataset_overview": dataset_overview, "split_expectation": split_expectation, "class_samples": class_samples,
    "module_activation": module_activation, "lexicon_flags": lexicon_flags, "domain_flag": domain_flag,
    "crop_resolution": crop_resolution, "topic_rules": topic_rules, "intent_rules": intent_rules,
    "urgency_rules": urgency_rules, "rule_predict": rule_predict_all, "multi_hot": multi_hot, "opening_hits": opening_hits,
}

# --- the same in SQL ---------------------------------------------------------------

_R = "WITH " + S.rules_cte()
_SHAPED = f"""shaped AS (SELECT *, {S.words('text')} AS words, {S.phrase('low', B.VAGUE)} AS is_vague FROM r)"""
_AGG = f"""count(*) AS total, count(*) FILTER (in_scope) AS domain_total,
 count(*) FILTER (words <= 5) AS short_rows, count(*) FILTER (is_vague) AS vague_rows,
 count(*) FILTER (len(topics) > 1) AS multi_topic_rows, count(*) FILTER (n_chars > {B.HARD_CHARS}) AS hard_rows,
 count(*) FILTER (in_scope AND thermal) AS lead_flag_rows"""
_STATS = f"""{_SHAPED}, counted AS (SELECT {_AGG} FROM shaped),
stats AS (SELECT *, total - domain_total AS non_domain_total,
 {S.safe('total - domain_total', 'total')} AS non_domain_ratio,
 {S.ratio('lead_flag_rows', 'domain_total')} AS lead_flag_ratio,
 {S.safe('short_rows', 'total')} AS short_ratio, {S.safe('vague_rows', 'total')} AS vague_ratio,
 {S.safe('multi_topic_rows', 'total')} AS multi_topic_ratio FROM counted)"""
_COMBO_VALUES = ", ".join(
    f"('{name}', {', '.join(str(v).lower() for v in values)}, {low})" for name, values, low in COMBOS)
_FLAGS = ", ".join(B.FLAGS)
_COMBOS = f"""wanted(combo, {_FLAGS}, min_n) AS (VALUES {_COMBO_VALUES}),
seen AS (SELECT {_FLAGS}, count(*) AS n FROM r GROUP BY ALL),
combos AS (SELECT combo, coalesce(n, 0) AS n, min_n, coalesce(n, 0) >= min_n AS ok
 FROM wanted LEFT JOIN seen USING ({_FLAGS}))"""
_DUPS = f"""dups AS (SELECT md5({S.norm('text')}) AS norm_key, count(*) AS n, min(doc_id) AS first_doc_id
 FROM documents GROUP BY 1 HAVING count(*) > 1)"""


def _bands(bands) -> str:
    rows = []
    for b in bands:
        low = f"WHEN {b.check} < {b.lo} THEN '{b.low_label}'" if b.lo is not None else ""
        high = f"WHEN {b.check} > {b.hi} THEN '{b.high_label}'" if b.hi is not None else ""
        lo = "NULL" if b.lo is None else b.lo
        hi = "NULL" if b.hi is None else b.hi
        rows.append(f"""SELECT '{b.check}' AS "check", CAST({b.check} AS DOUBLE) AS value, CAST({lo} AS DOUBLE) AS lo,
 CAST({hi} AS DOUBLE) AS hi, CASE {low} {high} ELSE 'ok' END AS status FROM stats""")
    return " UNION ALL ".join(rows)


_TOPIC_VALUES = ", ".join(f"('{t}')" for t in (*B.SPEC.topics, "never_seen"))
_JOIN = lambda c: f"CASE WHEN len({c}) = 0 THEN 'none' ELSE array_to_string({c}, ', ') END"

ORACLE = {
    "opening_hits": """WITH openings AS (SELECT DISTINCT source AS label, left(lower(text), 12) AS keyword FROM documents)
 SELECT label, keyword, count(*) AS n_docs FROM openings JOIN (SELECT lower(text) AS low FROM documents) ON contains(low, keyword)
 WHERE keyword <> '' GROUP BY label, keyword""",
    "normalize_text": f"SELECT doc_id, {S.norm('text')} AS norm FROM documents",
    "text_shape": f"""SELECT doc_id, words, words <= 5 AS is_short, is_vague FROM (
 SELECT doc_id, {S.words('text')} AS words, {S.phrase('lower(text)', B.VAGUE)} AS is_vague FROM documents)""",
    "token_features": f"""SELECT doc_id, len(f) AS n_features, list_min(f) AS first_feature, list_max(f) AS last_feature FROM (
 SELECT doc_id, {S.FEATURES} AS f FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM documents))""",
    "violations": f"""WITH dl AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
keyed AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5({S.norm('text')})) AS first_id FROM dl)
SELECT doc_id, 'bad_length' AS rule, CAST(n_chars AS VARCHAR) AS detail FROM dl WHERE n_chars <> length(text)
UNION ALL SELECT doc_id, 'short_text', NULL FROM dl WHERE ({S.words('text')}) <= 5
UNION ALL SELECT doc_id, 'blank_text', NULL FROM dl WHERE {S.strip('text')} = ''
UNION ALL SELECT doc_id, 'unknown_lang', lang FROM dl WHERE lang NOT IN ('en', 'fr', 'de')
UNION ALL SELECT doc_id, 'bad_source', source FROM dl WHERE NOT regexp_full_match(source, 'src[0-9]')
UNION ALL SELECT doc_id, 'toxic_but_low_quality', NULL FROM dl WHERE toxic = 1 AND quality = 0
UNION ALL SELECT doc_id, 'repeated_text', CAST(first_id AS VARCHAR) FROM keyed WHERE doc_id > first_id""",
    "duplicate_groups": f"WITH {_DUPS} SELECT * FROM dups",
    "corpus_stats": f"{_R}, {_STATS} SELECT * FROM stats",
    "scalar_histogram": """WITH c AS (SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY ALL
 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL)
SELECT field, value, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM documents) AS share FROM c""",
    "array_histogram": f"""{_R}, e AS (SELECT 'topics' AS field, unnest(topics) AS value FROM r
 UNION ALL SELECT 'crops', unnest(crops) FROM r)
SELECT field, value, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM r WHERE in_scope) AS share
FROM e GROUP BY ALL""",
    "flag_histogram": f"{_R} " + " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{v}' AS value, count(*) FILTER ({f} = {v}) AS n FROM r" for f in B.FLAGS for v in ("true", "false")),
    "combo_counts": f"{_R} SELECT {_FLAGS}, count(*) AS n FROM r GROUP BY ALL",
    "combo_minimums": f"{_R}, {_COMBOS} SELECT combo, n, min_n, ok FROM combos",
    "label_coverage": f"""{_R}, space(label) AS (VALUES {_TOPIC_VALUES}),
c AS (SELECT label, count(*) AS n FROM (SELECT unnest(topics) AS label FROM r) GROUP BY ALL),
l AS (SELECT greatest(20, CAST(floor(count(*) * CAST(0.04 AS DOUBLE)) AS BIGINT)) AS min_n FROM r WHERE in_scope)
SELECT label, coalesce(n, 0) AS n, min_n, coalesce(n, 0) < min_n AS low FROM space LEFT JOIN c USING (label) CROSS JOIN l""",
    "distribution_gate": f"""{_R}, {_STATS}, {_COMBOS}, checks AS ({_bands(BANDS)}
 UNION ALL SELECT 'combo:' || combo, CAST(n AS DOUBLE), CAST(min_n AS DOUBLE), NULL, CASE WHEN ok THEN 'ok' ELSE 'low' END FROM combos)
SELECT *, CASE WHEN status = 'ok' THEN 'none' ELSE 'fail' END AS severity FROM checks""",
    "audit_findings": f"""{_R}, {_STATS}, {_COMBOS}, {_DUPS}, checks AS ({_bands(AUDIT)}),
t AS (SELECT value, CAST(count(*) AS DOUBLE) / (SELECT greatest(domain_total, 1) FROM stats) AS share
 FROM (SELECT unnest(topics) AS value FROM r) GROUP BY value),
found AS (SELECT status AS kind, "check" AS subject, value FROM checks WHERE status <> 'ok'
 UNION ALL SELECT CASE WHEN n = 0 THEN 'missing_combo' ELSE 'sparse_combo' END, combo, CAST(n AS DOUBLE) FROM combos WHERE n < {AUDIT_COMBO_SPARSE}
 UNION ALL SELECT CASE WHEN share < 0.08 THEN 'rare_topic' ELSE 'frequent_topic' END, value, share FROM t WHERE share < 0.08 OR share > 0.22
 UNION ALL SELECT 'duplicate_inputs', 'input', CAST(count(*) AS DOUBLE) FROM dups HAVING count(*) > 0)
SELECT * FROM found UNION ALL SELECT 'none', 'none', 0.0 WHERE NOT EXISTS (SELECT 1 FROM found)""",
    "audit_diff": f"""{_R}, {_SHAPED}, g AS (SELECT CASE WHEN length(source) = 4 THEN 'before' ELSE 'after' END AS snapshot, {_AGG} FROM shaped GROUP BY 1),
long AS ({' UNION ALL '.join(f"SELECT snapshot, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM g" for m in STATS)}),
s AS (SELECT metric, max(value) FILTER (snapshot = 'before') AS before, max(value) FILTER (snapshot = 'after') AS after FROM long GROUP BY metric)
SELECT metric, before, after, after - before AS delta FROM s""",
    "dataset_overview": f"""{_R}, e AS (SELECT 'in_scope' AS field, CAST(in_scope AS VARCHAR) AS value FROM r
 UNION ALL SELECT 'intent', intent FROM r UNION ALL SELECT 'crops', unnest(crops) FROM r UNION ALL SELECT 'topics', unnest(topics) FROM r
 {' '.join(f"UNION ALL SELECT '{f}', 'true' FROM r WHERE {f}" for f in B.FLAGS)})
SELECT field, value, count(*) AS n FROM e GROUP BY ALL""",
    "split_expectation": """WITH w(split, expected) AS (VALUES ('en', 620), ('fr', 100), ('de', 129), ('it', 5)),
a AS (SELECT lang AS split, count(*) AS actual FROM documents GROUP BY 1)
SELECT split, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual,
 coalesce(expected, 0) = coalesce(actual, 0) AS ok FROM w FULL JOIN a USING (split)""",
    "class_samples": f"""{_R}, e AS (SELECT lang AS class, doc_id FROM r UNION ALL SELECT 'outside', doc_id FROM r WHERE NOT in_scope
 UNION ALL SELECT 'hard', doc_id FROM r WHERE n_chars > {B.HARD_CHARS} AND in_scope)
SELECT class, pick, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY doc_id) AS pick FROM e) WHERE pick <= 3""",
    "module_activation": f"{_R}, e AS (SELECT unnest(CASE WHEN len(x) = 0 THEN ['none'] ELSE x END) AS module FROM (SELECT "
    + S.picked([(m, f) for f, m in B.MODULES.items()]) + " AS x FROM r)) SELECT module, count(*) AS n FROM e GROUP BY ALL",
    "lexicon_flags": f"{_R} SELECT doc_id, {_FLAGS} FROM r",
    "domain_flag": f"WITH {S.rules_cte()}, h AS (SELECT doc_id, "
    + " OR ".join(S.anykw(w) for lex in (B.RULES.flag_keywords, B.RULES.topic_keywords, B.RULES.crop_keywords) for w in lex.values())
    + " AS plain_in_scope FROM low) SELECT doc_id, plain_in_scope, in_scope FROM h JOIN r USING (doc_id)",
    "crop_resolution": f"{_R} SELECT doc_id, {_JOIN('crops')} AS crops FROM r",
    "topic_rules": f"{_R} SELECT doc_id, {_JOIN('topics')} AS topics FROM r",
    "intent_rules": f"{_R} SELECT doc_id, intent FROM r",
    "urgency_rules": f"{_R} SELECT doc_id, urgency FROM r",
    "rule_predict": f"{_R} SELECT doc_id, in_scope, {_FLAGS}, {_JOIN('crops')} AS crops, {_JOIN('topics')} AS topics, intent, urgency FROM r",
    "multi_hot": f"{_R} SELECT doc_id, "
    + " || ".join(f"CASE WHEN list_contains(topics, '{t}') THEN '1' ELSE '0' END" for t in B.SPEC.topics)
    + f" AS bits, {_JOIN('topics')} AS topics FROM r",
}
