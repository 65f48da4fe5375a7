"""Log fold, feedback mining, corpus synthesis, and the streaming versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from labelmill.functions import text as X
from labelmill.operators import feedback as FB
from labelmill.operators import logodds as H
from labelmill.operators import synth as M
from labelmill.operators.scale import cut_lineage, join_by_key, run_dir
from labelmill.plans import bindings as B
from labelmill.plans import sqltext as S
from labelmill.streaming import live

FIELDS = ("level", "large", "tags")
SHOWN = ("level", "large")


def _labels(column: str) -> list[Column]:
    known = F.col(column).isNotNull()
    return [F.col(f"{column}.{n}").alias(f"{column}_{n}") for n in SHOWN] + [
        F.when(known, X.join_list(F.col(f"{column}.tags"))).alias(f"{column}_tags")]


def _shown(folded):
    return folded.select("interaction_id", "id", "timestamp", "input", F.col("confidence")["value"].alias("confidence"),
                         "user_feedback", "review_count", *_labels("prediction"), *_labels("corrected_labels"))


def folded(spark, sf):
    return FB.fold(B.log(spark, sf))


def fold_interactions(spark, sf):
    return _shown(folded(spark, sf))


def reviews(spark, sf):
    """Review rows of known interactions."""
    log = B.log(spark, sf)
    return FB.reviews_of(log, FB.fold(log)).select("interaction_id", "id", "timestamp", "user_feedback")


def resolved(spark, sf):
    return FB.add_resolved(folded(spark, sf)).select("interaction_id", "user_feedback", *_labels("final"))


def feedback_rows(spark, sf):
    rows = FB.feedback_rows(folded(spark, sf))
    return rows.select("id", "input", *_labels("labels"), F.col("meta.source_type").alias("source_type"),
                       F.col("meta.original_interaction_id").alias("interaction_id"),
                       F.col("meta.review_count").alias("review_count"), F.col("meta.feedback").alias("feedback"))


def review_queue(spark, sf):
    return FB.review_queue(folded(spark, sf)).select("interaction_id", "timestamp", "review_count")


def corrections(spark, sf):
    """Correction text of each review parsed into labels; blanks keep the
    predicted value."""
    kind = F.col("event_type")
    reviews = B.table(spark, sf, "events").filter(kind.isin("purchase", "error")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("interaction_id"), "event_id", "event_type", "value")
    known = folded(spark, sf).filter("review_count > 0").select("interaction_id", "prediction", "review_count")
    rows = join_by_key(reviews, known, "interaction_id", "review_count")
    raw_bool = F.when(F.col("value") > 30, " Yes ").when(F.col("value") > 10, "no").otherwise(" ")
    raw_list = F.when(F.col("value") > 20, F.concat(F.col("event_type"), F.lit(" , ,b"))).otherwise("")
    raw_text = F.when(F.col("value") > 15, F.concat(F.lit(" "), F.col("event_type"))).otherwise("  ")
    return rows.select(
        "event_id", X.parse_bool(raw_bool, F.col("prediction.large")).alias("large"),
        X.join_list(X.parse_list(raw_list, F.col("prediction.tags"))).alias("tags"),
        X.parse_text(raw_text, F.col("prediction.level")).alias("level"))


def mined(spark, sf):
    return FB.add_resolved(folded(spark, sf))


def field_errors(spark, sf):
    return FB.field_errors(mined(spark, sf), FIELDS, ["tags"])


def doc_pairs(spark, sf):
    """Documents as reviewed interactions: rule flags against text truth."""
    frame = B.frame(spark, sf)
    pred = F.struct(*[F.col(f"pred_{c}").alias(c) for c in (*B.FLAGS, "topics", "lang")])
    true = F.struct(*[F.col(f"true_{c}").alias(c) for c in (*B.FLAGS, "topics", "lang")])
    return frame.select("doc_id", pred.alias("prediction"), true.alias("final"))


DOC_FIELDS = (*B.FLAGS, "topics", "lang")


def doc_field_errors(spark, sf):
    return FB.field_errors(doc_pairs(spark, sf), DOC_FIELDS, ["topics"], keep=["doc_id"])


def failure_patterns(spark, sf):
    marked = FB.add_mismatches(doc_pairs(spark, sf), DOC_FIELDS, ["topics"])
    return FB.failure_patterns(marked, F.col("doc_id"), 10)


def field_confusions(spark, sf):
    errors = FB.field_errors(doc_pairs(spark, sf), DOC_FIELDS, ["topics"], keep=["doc_id"])
    return FB.field_confusions(errors, F.col("doc_id"), 5)


def feedback_summary(spark, sf):
    return FB.feedback_summary(FB.add_mismatches(mined(spark, sf), FIELDS, ["tags"]))


def field_error_counts(spark, sf):
    return FB.field_error_counts(doc_field_errors(spark, sf))


def failure_examples(spark, sf):
    """First ten interactions with errors, by time and id."""
    marked = FB.add_mismatches(mined(spark, sf), FIELDS, ["tags"])
    return FB.failure_examples(marked, ["timestamp", "interaction_id"]).select(
        "interaction_id", X.join_list(F.array_sort("mismatches")).alias("mismatches"), "user_feedback")


# --- synthesis -------------------------------------------------------------------

WINDOWS = ("today", "next week")
BID_TEMPLATES = ("What do {segment} bids do in zone {zone} {window}?", "Any {segment} news for zone {zone}?",
                 "{segment} outlook {window}")
STOCK_TEMPLATES = ("Any {segment} news for zone {zone}?", "Who ships to zone {zone} {window}?")
PART_TEMPLATES = ("Is the {name} of {brand} back {window}?", "{name} outlook {window}")
CATEGORIES = (("bids", 60), ("stock", 25), ("parts", 40))
SPLITS = (("train", 90), ("val", 15), ("test", 15))


def bids(spark, sf):
    base = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    slots = {"segment": F.lower("c_mktsegment"), "zone": F.col("c_nationkey").cast("string")}
    return M.template_grid(base, "bids", BID_TEMPLATES, slots, {"window": WINDOWS}, ["c_custkey"])


def stock(spark, sf):
    base = B.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    slots = {"segment": F.when(F.col("s_acctbal") > 5000, "furniture").otherwise("machinery"),
             "zone": F.col("s_nationkey").cast("string")}
    return M.template_grid(base, "stock", STOCK_TEMPLATES, slots, {"window": WINDOWS}, ["s_suppkey"])


def parts(spark, sf):
    base = B.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    slots = {"name": F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.lit("Furniture")).otherwise(F.col("p_name")), "brand": F.col("p_brand")}
    return M.template_grid(base, "parts", PART_TEMPLATES, slots, {"window": WINDOWS}, ["p_partkey"])


def existing(spark, sf):
    """Texts that are in the corpus already, one per supplier."""
    zone = F.col("s_nationkey").cast("string")
    return B.table(spark, sf, "supplier").select(
        F.concat(F.lit("route_"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("id"),
        F.concat(F.lit("ANY household  news for zone "), zone, F.lit("?")).alias("input"))


def template_grid(spark, sf):
    grid = M.indexed_labels(bids(spark, sf), M.cyclic_labels(F.col("template_pos"), B.SPEC.intents, B.SPEC.urgencies))
    return grid.select("c_custkey", "template_pos", "candidate", F.array_join(F.transform("order_key", lambda k: k.cast("string")), "-").alias("order_key"),
                       "intent", "urgency", "difficulty")


def recycled_candidates(spark, sf):
    again = M.recycled(bids(spark, sf))
    return again.select("c_custkey", "template_pos", "pass", "candidate")


def unique_candidates(spark, sf):
    fresh = M.unique_candidates(bids(spark, sf), existing(spark, sf))
    return fresh.select("norm_key", "candidate", "c_custkey", "template_pos")


def accepted(spark, sf):
    grids = {"bids": bids(spark, sf), "stock": stock(spark, sf), "parts": parts(spark, sf)}
    same = [(grids[name].select("candidate", "order_key", "template_pos"), name, quota) for name, quota in CATEGORIES]
    return M.fill_quotas(same, existing(spark, sf))


def quota_rows(spark, sf):
    return accepted(spark, sf).select("category_pos", "category", "candidate", "template_pos")


def quota_shortfall(spark, sf):
    return M.quota_shortfall(accepted(spark, sf), [*CATEGORIES, ("absent", 3)])


def split_alloc(spark, sf):
    rows = M.assign_ids(accepted(spark, sf), existing(spark, sf), [F.col("category_pos"), F.col("order_key")])
    return M.allocate_splits(rows, SPLITS).select("id", "split", "category", "candidate", "add_pos")


def stratified_split(spark, sf):
    """Every stratum spread over all splits by a hash of the row key."""
    out = M.allocate_stratified(B.documents(spark, sf).select("doc_id", "lang"), ["lang"], "doc_id",
                                [("train", 0.75), ("val", 0.125), ("test", 0.125)])
    return out.select("doc_id", "lang", "split")


def phrase_pool(spark, sf):
    pool = B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("phrase"))
    corpus = B.documents(spark, sf).select(F.col("text").alias("input"))
    return M.phrase_pool(pool, corpus, ["item_id"], 160).select("pick", "phrase")


def ranked_rewrite(spark, sf):
    """The k-th document with a license line gets the k-th unused phrase."""
    docs = B.documents(spark, sf).select("doc_id", "text", "lang", F.lit("kept").alias("notes"))
    wanted = F.lower("text").contains("license")
    picks = M.pick_rows(docs, wanted, "doc_id", ["doc_id"], 160)
    pool = M.phrase_pool(B.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("phrase")),
                         docs.select(F.col("text").alias("input")), ["item_id"], 160)
    out = M.ranked_rewrite(docs, picks, pool, "doc_id", "text", updates={
        "notes": F.when(F.pmod("pick", F.lit(3)) == 0, "hard").otherwise("medium")})
    return out.select("doc_id", "rewritten", "notes", F.md5("text").alias("text_key"))


def topic_rewrite(spark, sf):
    """New texts for all documents with a topic, by first topic and rank."""
    # Written first: ranking reads its input twice, and the rules are not cheap.
    ruled = cut_lineage(B.ruled(spark, sf).select("doc_id", "topics", "lang"))
    rows = ruled.filter(F.size("topics") > 0)
    ranked = M.global_rank(rows, [F.col("doc_id")], "pick").withColumn("pick", F.col("pick") - 1)
    out = M.topic_rewrite(
        ranked, {"thermal": ("Is {field} hot {window}?", "Heat on {field}?"), "legal": ("May I use {field}?",)},
        {"field": ("plot one", "the slope", "the east strip"), "window": WINDOWS},
        [(F.col("lang") == "fr", "Une question sur {field}")], "What is wrong at {field}?", F.get("topics", F.lit(0)))
    return out.select("doc_id", "pick", "new_text")


# --- streams ---------------------------------------------------------------------

def _stream(spark, sf, name):
    """A table as a stream, whether it is one file or a folder of them.

    As a pattern, as the path of a stream that is no pattern has to be a folder.
    """
    schema = B.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/[{name[0]}]{name[1:]}.parquet")


def _scratch(spark):
    return f"{run_dir(spark)}/{uuid.uuid4().hex}"


def stream_route(spark, sf):
    """Conversations routed as a stream, appended to a table and read back."""
    scorer = H.compile_model(H.fit(B.training(spark, sf), B.spec_heads(), "text"))
    turns = _stream(spark, sf, "conversations").filter(F.col("role") == "user").select("conv_id", "turn", "text")
    routed = live.route_stream(turns, scorer, B.RULES, "text").select(
        "conv_id", "turn", "in_scope", *B.FLAGS, X.join_list(F.col("crops")).alias("crops"),
        X.join_list(F.col("topics")).alias("topics"), "intent", "urgency")
    folder = _scratch(spark)
    live.append_stream(routed, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_fold(spark, sf):
    """The log folded as a stream; the same rows as the batch fold."""
    folder = _scratch(spark)
    events = B.as_log(_stream(spark, sf, "events"))
    live.fold_stream(events, f"{folder}/out", f"{folder}/state").awaitTermination()
    return _shown(live.read_fold(spark, f"{folder}/out"))


QUERIES = {
    "fold_interactions": fold_interactions, "interaction_reviews": reviews, "resolved": resolved,
    "feedback_rows": feedback_rows, "review_queue": review_queue, "corrections": corrections,
    "field_errors": field_errors, "doc_field_errors": doc_field_errors, "failure_patterns": failure_patterns,
    "field_confusions": field_confusions, "feedback_summary": feedback_summary,
    "field_error_counts": field_error_counts, "failure_examples": failure_examples, "template_grid": template_grid,
    "recycled_candidates": recycled_candidates, "unique_candidates": unique_candidates, "quota_rows": quota_rows,
    "quota_shortfall": quota_shortfall, "split_alloc": split_alloc, "stratified_split": stratified_split,
    "phrase_pool": phrase_pool, "ranked_rewrite": ranked_rewrite, "topic_rewrite": topic_rewrite,
    "stream_route": stream_route, "stream_fold": stream_fold,
}

# --- the same in SQL ---------------------------------------------------------------

_BAND = lambda lo, hi: f"CASE WHEN value < {lo} THEN 'low' WHEN value < {hi} THEN 'medium' ELSE 'high' END"
_TAGS = "CASE WHEN value > 30 THEN ['a', 'b'] ELSE ['b'] END"
_LOG = f"""ev AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, 'u' || CAST(user_id AS VARCHAR) AS interaction_id, event_type,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, value, props, {_BAND(5.0, 20.0)} AS level, value > 10 AS large, {_TAGS} AS tags,
 {_BAND(8.0, 20.0)} AS c_level, value > 13 AS c_large FROM events),
inf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY timestamp DESC, id DESC) AS rn
 FROM ev WHERE event_type = 'view') WHERE rn = 1),
rev AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'correct' WHEN value >= 4 THEN 'incorrect' END AS fb,
 row_number() OVER (PARTITION BY interaction_id ORDER BY timestamp DESC, id DESC) AS rn,
 count(*) OVER (PARTITION BY interaction_id) AS n FROM ev WHERE event_type IN ('purchase', 'error')),
cor AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interaction_id ORDER BY timestamp DESC, id DESC) AS rn
 FROM ev WHERE event_type = 'error' AND value >= 8) WHERE rn = 1),
fold AS (SELECT i.interaction_id, i.id, i.timestamp, i.props AS input, i.value AS confidence, r.fb AS user_feedback,
 CAST(coalesce(r.n, 0) AS INT) AS review_count, i.level, i.large, i.tags, c.interaction_id IS NOT NULL AS fixed, c.c_level, c.c_large, c.tags AS c_tags
 FROM inf i LEFT JOIN (SELECT * FROM rev WHERE rn = 1) r USING (interaction_id) LEFT JOIN cor c USING (interaction_id)),
fin AS (SELECT *, fixed OR user_feedback IS NOT DISTINCT FROM 'correct' AS done, CASE WHEN fixed THEN c_level ELSE level END AS f_level,
 CASE WHEN fixed THEN c_large ELSE large END AS f_large, CASE WHEN fixed THEN c_tags ELSE tags END AS f_tags FROM fold)"""
_T = lambda c: f"array_to_string({c}, ', ')"
_FOLD = f"""WITH {_LOG} SELECT interaction_id, id, timestamp, input, confidence, user_feedback, review_count,
 level AS prediction_level, large AS prediction_large, {_T('tags')} AS prediction_tags,
 c_level AS corrected_labels_level, c_large AS corrected_labels_large, {_T('c_tags')} AS corrected_labels_tags FROM fold"""

_DOCERR = f"""WITH {S.frame_cte()}, fe AS ({' UNION ALL '.join(
    f"SELECT doc_id, {i} AS pos, '{c}' AS field, CAST(pred_{c} AS VARCHAR) AS pred_value, CAST(true_{c} AS VARCHAR) AS final_value FROM p WHERE pred_{c} <> true_{c}"
    if c != 'topics' else
    f"SELECT doc_id, {i}, 'topics', '[' || {_T('pred_topics')} || ']', '[' || {_T('true_topics')} || ']' FROM p WHERE list_sort(pred_topics) <> list_sort(true_topics)"
    for i, c in enumerate(DOC_FIELDS))})"""


def _grid(table: str, key: str, name: str, templates, slots: dict[str, str], windows=WINDOWS) -> str:
    w = ", ".join(f"({i}, '{x}')" for i, x in enumerate(windows))
    t = ", ".join(f"({i}, '{x}')" for i, x in enumerate(templates))
    filled = "template"
    for slot, expression in {**slots, "window": "win"}.items():
        filled = f"replace({filled}, '{{{slot}}}', {expression})"
    return f"""{name} AS (SELECT *, {filled} AS candidate FROM {table}
 CROSS JOIN (VALUES {w}) w(w_pos, win) CROSS JOIN (VALUES {t}) t(template_pos, template))"""


_BIDS = _grid("customer", "c_custkey", "bids", BID_TEMPLATES, {"segment": "lower(c_mktsegment)", "zone": "CAST(c_nationkey AS VARCHAR)"})
_STOCK = _grid("supplier", "s_suppkey", "stock", STOCK_TEMPLATES, {
    "segment": "CASE WHEN s_acctbal > 5000 THEN 'furniture' ELSE 'machinery' END", "zone": "CAST(s_nationkey AS VARCHAR)"})
_PARTS = _grid("part", "p_partkey", "parts", PART_TEMPLATES, {
    "name": "CASE WHEN p_partkey % 3 = 0 THEN 'Furniture' ELSE p_name END", "brand": "p_brand"})
_EXIST = f"""ex AS (SELECT 'ANY household  news for zone ' || CAST(s_nationkey AS VARCHAR) || '?' AS input, s_suppkey FROM supplier),
exk AS (SELECT DISTINCT {S.norm('input')} AS norm FROM ex)"""


def _uniq(name: str, key: str, out: str, block: str = "") -> str:
    return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY {key}, w_pos, template_pos) AS dup
 FROM (SELECT *, {S.norm('candidate')} AS norm FROM {name})) WHERE dup = 1 AND norm <> '' AND norm NOT IN (SELECT norm FROM exk){block})"""


def _take(source: str, key: str, pos: int, name: str, quota: int) -> str:
    return f"""a{pos} AS (SELECT {pos} AS category_pos, '{name}' AS category, candidate, template_pos, norm, rn FROM (
 SELECT *, row_number() OVER (ORDER BY {key}, w_pos, template_pos) AS rn FROM {source}) WHERE rn <= {quota})"""


_ACC = ", ".join([
    _EXIST, _BIDS, _STOCK, _PARTS, _uniq("bids", "c_custkey", "u0"), _take("u0", "c_custkey", 0, *CATEGORIES[0]),
    _uniq("stock", "s_suppkey", "u1", " AND norm NOT IN (SELECT norm FROM a0)"), _take("u1", "s_suppkey", 1, *CATEGORIES[1]),
    _uniq("parts", "p_partkey", "u2", " AND norm NOT IN (SELECT norm FROM a0) AND norm NOT IN (SELECT norm FROM a1)"),
    _take("u2", "p_partkey", 2, *CATEGORIES[2]),
    "acc AS (SELECT * FROM a0 UNION ALL SELECT * FROM a1 UNION ALL SELECT * FROM a2)"])
_POOL = f"""pool AS (SELECT rn - 1 AS pick, phrase FROM (SELECT phrase, row_number() OVER (ORDER BY item_id) AS rn FROM (
 SELECT item_id, text AS phrase, {S.norm('text')} AS norm, row_number() OVER (PARTITION BY {S.norm('text')} ORDER BY item_id) AS dup FROM benchmark)
 WHERE dup = 1 AND norm <> '' AND norm NOT IN (SELECT {S.norm('text')} FROM documents)) WHERE rn <= 160)"""
_CYCLE = lambda labels: f"(CAST([{', '.join(repr(x) for x in labels)}] AS VARCHAR[]))[template_pos % {len(labels)} + 1]"
_NEW = """CASE WHEN topics[1] = 'thermal' THEN (CAST(['Is {field} hot {window}?', 'Heat on {field}?'] AS VARCHAR[]))[pick % 2 + 1]
 WHEN topics[1] = 'legal' THEN 'May I use {field}?' WHEN lang = 'fr' THEN 'Une question sur {field}' ELSE 'What is wrong at {field}?' END"""


def _route_stream_sql() -> str:
    from labelmill.plans import model_queries as Q

    rules = S.rules_cte().replace("FROM documents", "FROM turns").replace("doc_id", "row_id").replace(
        "lang, source, n_chars, lower(text)", "'x' AS lang, 'x' AS source, 0 AS n_chars, lower(text)")
    scores = Q._SCORES.replace("FROM documents d", "FROM turns d").replace("FROM documents", "FROM turns").replace("doc_id", "row_id")
    model = Q._MODEL.replace("doc_id", "row_id")
    turns = f"turns AS (SELECT conv_id * 1000000 + turn AS row_id, conv_id, turn, text FROM conversations WHERE role = 'user' AND {S.strip('text')} <> '')"
    return f"""WITH {turns}, {rules}, {Q._fit_ctes(Q._SPEC)}, {scores}, {model}
SELECT conv_id, turn, in_scope, {', '.join(f'in_scope AND (m_{f} OR {f}) AS {f}' for f in B.FLAGS)},
 CASE WHEN in_scope THEN {Q._JOIN('crops')} ELSE 'none' END AS crops,
 CASE WHEN in_scope THEN {Q._JOIN(f'list_sort(list_distinct(list_concat({Q._MT}, topics)))')} ELSE 'none' END AS topics,
 CASE WHEN in_scope AND intent <> 'other' THEN intent ELSE m_intent END AS intent,
 CASE WHEN in_scope THEN urgency ELSE 'low' END AS urgency
FROM r JOIN model USING (row_id) JOIN turns USING (row_id)"""


ORACLE = {
    "fold_interactions": _FOLD,
    "interaction_reviews": f"WITH {_LOG} SELECT interaction_id, id, timestamp, fb AS user_feedback FROM rev WHERE interaction_id IN (SELECT interaction_id FROM inf)",
    "resolved": f"""WITH {_LOG} SELECT interaction_id, user_feedback, CASE WHEN done THEN f_level END AS final_level,
 CASE WHEN done THEN f_large END AS final_large, CASE WHEN done THEN {_T('f_tags')} END AS final_tags FROM fin""",
    "feedback_rows": f"""WITH {_LOG} SELECT 'feedback_' || interaction_id AS id, input, f_level AS labels_level, f_large AS labels_large,
 {_T('f_tags')} AS labels_tags, 'real_world_feedback' AS source_type, interaction_id, review_count, user_feedback AS feedback FROM fin WHERE done""",
    "review_queue": f"WITH {_LOG} SELECT interaction_id, timestamp, review_count FROM fold WHERE user_feedback IS NULL",
    "corrections": f"""WITH {_LOG} SELECT event_id, CASE WHEN e.value > 30 THEN true WHEN e.value > 10 THEN false ELSE large END AS large,
 CASE WHEN e.value > 20 THEN e.event_type || ', b' ELSE {_T('tags')} END AS tags,
 CASE WHEN e.value > 15 THEN e.event_type ELSE level END AS level
FROM fold JOIN events e ON fold.interaction_id = 'u' || CAST(e.user_id AS VARCHAR) WHERE e.event_type IN ('purchase', 'error')""",
    "field_errors": f"""WITH {_LOG} SELECT interaction_id, 'level' AS field, level AS pred_value, f_level AS final_value FROM fin WHERE done AND level <> f_level
 UNION ALL SELECT interaction_id, 'large', CAST(large AS VARCHAR), CAST(f_large AS VARCHAR) FROM fin WHERE done AND large <> f_large
 UNION ALL SELECT interaction_id, 'tags', '[' || {_T('tags')} || ']', '[' || {_T('f_tags')} || ']' FROM fin WHERE done AND list_sort(tags) <> list_sort(f_tags)""",
    "doc_field_errors": f"{_DOCERR} SELECT doc_id, field, pred_value, final_value FROM fe",
    "failure_patterns": f"""{_DOCERR}, pt AS (SELECT doc_id, string_agg(field, ', ' ORDER BY field) AS pattern FROM fe GROUP BY doc_id)
SELECT pattern, count(*) AS n, min(doc_id) AS first_seen FROM pt GROUP BY pattern ORDER BY n DESC, first_seen LIMIT 10""",
    "field_confusions": f"""{_DOCERR}, c AS (SELECT field, pred_value, final_value, count(*) AS n, min(doc_id) AS first_seen FROM fe GROUP BY ALL)
SELECT field, pred_value, final_value, n, first_seen, position FROM (
 SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, first_seen) AS position FROM c) WHERE position <= 5""",
    "feedback_summary": f"""WITH {_LOG} SELECT count(*) AS reviewed, count(*) FILTER (level <> f_level OR large <> f_large OR list_sort(tags) <> list_sort(f_tags)) AS with_errors
FROM fin WHERE done""",
    "field_error_counts": f"{_DOCERR} SELECT field, count(*) AS n FROM fe GROUP BY field",
    "failure_examples": f"""WITH {_LOG}, e AS (SELECT interaction_id, timestamp, user_feedback, {S.picked([
        ("large", "large <> f_large"), ("level", "level <> f_level"), ("tags", "list_sort(tags) <> list_sort(f_tags)")])} AS m FROM fin WHERE done)
SELECT interaction_id, {_T('m')} AS mismatches, user_feedback FROM e WHERE len(m) > 0 ORDER BY timestamp, interaction_id LIMIT 10""",
    "template_grid": f"""WITH {_BIDS} SELECT c_custkey, template_pos, candidate, CAST(c_custkey AS VARCHAR) || '-' || CAST(w_pos AS VARCHAR) || '-' || CAST(template_pos AS VARCHAR) AS order_key,
 {_CYCLE(B.SPEC.intents)} AS intent, {_CYCLE(B.SPEC.urgencies)} AS urgency,
 CASE WHEN template_pos % 4 = 0 THEN 'hard' WHEN template_pos % 2 = 1 THEN 'medium' ELSE 'simple' END AS difficulty FROM bids""",
    "recycled_candidates": f"""WITH {_BIDS} SELECT c_custkey, template_pos, pass, CASE WHEN pass = 0 THEN candidate ELSE rtrim(candidate, '?') || ', please.' END AS candidate
FROM bids CROSS JOIN (VALUES (0), (1)) v(pass)""",
    "unique_candidates": f"WITH {_EXIST}, {_BIDS}, {_uniq('bids', 'c_custkey', 'u')} SELECT md5(norm) AS norm_key, candidate, c_custkey, template_pos FROM u",
    "quota_rows": f"WITH {_ACC} SELECT category_pos, category, candidate, template_pos FROM acc",
    "quota_shortfall": f"""WITH {_ACC}, w(category, quota) AS (VALUES {', '.join(f"('{c}', {q})" for c, q in [*CATEGORIES, ('absent', 3)])}),
n AS (SELECT category, count(*) AS n FROM acc GROUP BY 1) SELECT category, quota, coalesce(n, 0) AS n, quota - coalesce(n, 0) AS missing FROM w LEFT JOIN n USING (category)""",
    "split_alloc": f"""WITH {_ACC}, o AS (SELECT *, row_number() OVER (ORDER BY category_pos, rn) AS add_pos FROM acc)
SELECT 'route_' || lpad(CAST(add_pos + (SELECT max(s_suppkey) FROM ex) AS VARCHAR), 6, '0') AS id,
 CASE WHEN add_pos <= 90 THEN 'train' WHEN add_pos <= 105 THEN 'val' WHEN add_pos <= 120 THEN 'test' END AS split, category, candidate, add_pos FROM o""",
    "stratified_split": """SELECT doc_id, lang, CASE WHEN x < 0.75 THEN 'train' WHEN x < 0.875 THEN 'val' ELSE 'test' END AS split FROM (
 SELECT doc_id, lang, CAST(CAST('0x' || substr(md5(lang || '/' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS x FROM documents)""",
    "phrase_pool": f"WITH {_POOL} SELECT pick, phrase FROM pool",
    "ranked_rewrite": f"""WITH {_POOL}, picks AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pick FROM documents WHERE contains(lower(text), 'license')),
m AS (SELECT doc_id, pick, phrase FROM picks JOIN pool USING (pick) WHERE pick < 160)
SELECT doc_id, phrase IS NOT NULL AS rewritten, CASE WHEN phrase IS NULL THEN 'kept' WHEN pick % 3 = 0 THEN 'hard' ELSE 'medium' END AS notes,
 md5(coalesce(phrase, text)) AS text_key FROM documents LEFT JOIN m USING (doc_id)""",
    "topic_rewrite": f"""WITH {S.rules_cte()}, k AS (SELECT doc_id, topics, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pick FROM r WHERE len(topics) > 0)
SELECT doc_id, pick, replace(replace({_NEW}, '{{field}}', (CAST(['plot one', 'the slope', 'the east strip'] AS VARCHAR[]))[pick % 3 + 1]),
 '{{window}}', (CAST(['today', 'next week'] AS VARCHAR[]))[pick % 2 + 1]) AS new_text FROM k""",
    "stream_route": _route_stream_sql(),
    "stream_fold": _FOLD,
}
