"""Token model, routing, evaluation of predictions, and vector models."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from labelmill.functions import text as X
from labelmill.operators import evaluate as L
from labelmill.operators import heads as HD
from labelmill.operators import logodds as H
from labelmill.operators import route as R
from labelmill.operators import vectors as K
from labelmill.operators.lexicon import rule_predict
from labelmill.plans import bindings as B
from labelmill.plans import sqltext as S

FIELDS = L.EvalFields(binary=B.FLAGS, classes=("lang",), sets={"topics": (*B.FLAGS, "general")})
EXPECTED = ("legal", "thermal")


def doc_frequency(spark, sf):
    """Number of documents of every feature."""
    return H.document_frequency(B.documents(spark, sf), "text")


def logodds_heads(spark, sf):
    model = H.fit(B.training(spark, sf), B.spec_heads(), "text")
    return model.heads.select("head", "field", "label", "label_pos", "bias", "threshold")


def logodds_weights(spark, sf):
    model = H.fit(B.training(spark, sf), B.small_heads(), "text")
    return model.weights.join(model.heads.select("head", "field", "label"), "head").select("field", "label", "feature", "weight")


def scored(spark, sf):
    scorer = H.compile_model(H.fit(B.training(spark, sf), B.small_heads(), "text"))
    return H.score_inline(B.documents(spark, sf).select("doc_id", "text"), scorer, "text"), scorer


def logodds_scores(spark, sf):
    """Score of every head for every document."""
    rows, scorer = scored(spark, sf)
    heads = F.array(*[F.struct(F.lit(h["field"]).alias("field"), F.lit(h["label"]).alias("label"),
                               F.get("score_sums", F.lit(i)).alias("total")) for i, h in enumerate(scorer.heads)])
    return rows.select("doc_id", F.inline(heads))


def logodds_scores_join(spark, sf):
    """The same through the join path for large models."""
    model = H.fit(B.training(spark, sf), B.small_heads(), "text")
    rows = H.score_join(B.documents(spark, sf), model, "doc_id", "text")
    return rows.join(model.heads.select("head", "field", "label"), "head").select("doc_id", "field", "label", "total")


def logodds_predict(spark, sf):
    rows, scorer = scored(spark, sf)
    out = H.add_decisions(rows.withColumn("score_probs", H.probabilities()), scorer, (), prefix="")
    return out.select("doc_id", "quality", "toxic", "lang")


def route(spark, sf):
    scorer = H.compile_model(H.fit(B.training(spark, sf), B.spec_heads(), "text"))
    texts, _ = R.split_blank(B.documents(spark, sf).select("doc_id", "text"), "text")
    out = R.route(texts, scorer, B.RULES, "text")
    return out.select("doc_id", "in_scope", *B.FLAGS, X.join_list(F.col("crops")).alias("crops"),
                      X.join_list(F.col("topics")).alias("topics"), "intent", "urgency")


def prediction_frame(spark, sf):
    """Truth and rule predictions, joined on the document id."""
    frame = B.frame(spark, sf)
    truth = frame.select("doc_id", "source", *[F.col(f"true_{c}").alias(c) for c in (*B.FLAGS, "topics", "lang")])
    pred = frame.select("doc_id", *[F.col(f"pred_{c}").alias(c) for c in (*B.FLAGS, "topics", "lang")])
    joined = L.prediction_frame(truth, pred, [*B.FLAGS, "topics", "lang"], "doc_id", "all", ["source"])
    flags = [F.col(f"{side}_{c}") for c in B.FLAGS for side in ("true", "pred")]
    return joined.select("doc_id", "split", "source", *flags, "true_lang", "pred_lang", "topic_count",
                         X.join_list(F.col("true_topics")).alias("true_topics"), X.join_list(F.col("pred_topics")).alias("pred_topics"))


def counts(spark, sf):
    return L.outcome_counts(B.frame(spark, sf), FIELDS)


def binary_metrics(spark, sf):
    return L.binary_metrics(L.outcome_counts(B.frame(spark, sf), L.EvalFields(binary=B.FLAGS)))


def macro_metrics(spark, sf):
    return L.class_metrics(L.outcome_counts(B.frame(spark, sf), L.EvalFields(classes=("lang",))))


def multilabel_metrics(spark, sf):
    return L.set_metrics(L.outcome_counts(B.frame(spark, sf), L.EvalFields(sets=FIELDS.sets)))


def all_metrics(spark, sf):
    return L.evaluate(B.frame(spark, sf), FIELDS)


def lang_scores(spark, sf):
    """Per-language tp, fp, fn, precision, recall and f1 of the language guess."""
    scores = L.class_label_scores(L.outcome_counts(B.frame(spark, sf), L.EvalFields(classes=("lang",))))
    return scores.select("label", "tp", "fp", "fn", "precision", "recall", "f1")


def confusion(spark, sf):
    return L.confusion(B.frame(spark, sf), "lang", B.LANG_SPACE)


def metric_compare(spark, sf):
    first = L.evaluate(B.frame(spark, sf), FIELDS)
    second = L.evaluate(B.frame(spark, sf, B.RULES_ALT_FLAGS), FIELDS)
    return L.compare_metrics(first, second, list(FIELDS.sets))


def decided(spark, sf):
    return L.add_decision(B.frame(spark, sf), B.FLAGS)


def routing_decisions(spark, sf):
    return decided(spark, sf).select("doc_id", "decision")


def decision_rates(spark, sf):
    return L.decision_rates(decided(spark, sf))


def breakdown(spark, sf):
    return L.decision_breakdown(decided(spark, sf), {
        "topic": X.default_list(F.col("true_topics")), "lang": F.array("true_lang"), "source": F.array("source")})


def decision_breakdown(spark, sf):
    return breakdown(spark, sf)


def worst_groups(spark, sf):
    return L.worst_groups(breakdown(spark, sf)).select("group_name", "position", "group_key", "total", "correct_rate")


def errors(spark, sf):
    rows = B.frame(spark, sf).withColumns({"topic": X.join_list(F.col("true_topics"))})
    return L.error_records(rows, FIELDS, ["doc_id", "source", "topic"])


def error_records(spark, sf):
    return errors(spark, sf)


def error_counts(spark, sf):
    return L.error_counts(errors(spark, sf), {"label": F.col("label"), "topic": F.col("topic"), "source": F.col("source")})


def error_hotspots(spark, sf):
    found = L.error_counts(errors(spark, sf), {"topic": F.col("topic"), "source": F.col("source")})
    return L.hotspots(found, 20).select("group_name", "position", "group_key", "n")


def error_examples(spark, sf):
    limits = {"all": 50, "false_positive": 10, "false_negative": 10}
    picks = L.error_examples(errors(spark, sf), [F.col("doc_id"), F.col("label_pos")], limits)
    return picks.select("list_name", "position", "doc_id", "label", "error_type")


def expectations(spark, sf):
    """Truth flags as expectations of the rule prediction; not checked for es."""
    frame = B.frame(spark, sf)
    checked = F.col("true_lang") != "es"
    cases = frame.select("doc_id", *[F.when(checked, F.col(f"true_{c}")).alias(f"exp_{c}") for c in EXPECTED],
                         F.col("true_topics").alias("exp_topics"))
    pred = rule_predict(B.documents(spark, sf), B.RULES, "text").select("doc_id", *EXPECTED, "topics")
    return L.check_expectations(cases, pred, EXPECTED, ["topics"], "doc_id")


def expectation_summary(spark, sf):
    return L.expectation_summary(expectations(spark, sf))


def vectors(spark, sf):
    rows = B.table(spark, sf, "embeddings")
    label = F.col("label")
    named = rows.withColumns({
        "large": label >= 5, "digit": label.cast("string"),
        "groups": F.array_compact(F.array(
            F.when(label % 2 == 0, F.lit("even")), F.when(label < 4, F.lit("small")), F.when(label > 7, F.lit("top")))).cast("array<string>"),
    })
    return K.embed(named)


def vector_norms(spark, sf):
    """Every part of every vector after normalisation."""
    return vectors(spark, sf).select("vec_id", F.posexplode(vector_to_array(F.col("vector"))).alias("place", "part")).withColumn("part", F.round("part", 6))


def class_weights(spark, sf):
    """Balanced weight of every class."""
    return K.balanced_weights(B.table(spark, sf, "embeddings").select("label"), "label").distinct().select("label", F.round("weight", 9).alias("weight"))


def _given(k: int):
    """Probability of a head whose coefficients are given by a rule, on the stored vectors."""
    shares = F.transform("embedding", lambda x, i: x.cast("double") * ((i * 7 + 3 * k) % 11 - 5) / 10.0)
    return X.sigmoid(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))


def vector_decisions(spark, sf):
    """Decisions of all three kinds from given coefficients: threshold, best label if it passes, and best label."""
    rows = B.table(spark, sf, "embeddings").withColumns({f"s{k}": _given(k) for k in range(3)})
    scores = [(label, F.col(f"s{k}")) for k, label in enumerate(("one", "two", "three"))]
    return rows.select(
        "vec_id", K.passes(F.col("s0")).alias("flag"), X.join_list(K.passing_labels(scores)).alias("labels"),
        X.join_list(K.best_if_passing(scores, 0.6)).alias("exclusive"), K.best_label(scores).alias("best"))


def lr_binary(spark, sf):
    rows = vectors(spark, sf)
    out = K.predict(rows, K.fit(rows, binary=["large"]))
    return out.select("vec_id", F.col("large").cast("int").alias("true_large"), "pred_large")


def lr_multilabel(spark, sf):
    rows = vectors(spark, sf)
    out = K.predict(rows, K.fit(rows, sets={"groups": ("even", "small", "top")}), exclusive=())
    return out.select("vec_id", X.join_list(F.col("groups")).alias("true_groups"), X.join_list(F.col("pred_groups")).alias("pred_groups"))


def lr_multiclass(spark, sf):
    rows = vectors(spark, sf)
    space = [str(i) for i in range(10)]
    out = K.predict(rows, K.fit(rows, classes={"digit": space}))
    return out.select("vec_id", F.col("digit").alias("true_digit"), "pred_digit")


def lr_heads(spark, sf):
    """All heads of the three kinds fitted together, and their predictions from one pass over the vectors."""
    rows = vectors(spark, sf)
    space = {"groups": ("even", "small", "top")}
    out = HD.predict(rows, HD.fit(rows, ["large"], space, {"digit": [str(i) for i in range(10)]}), exclusive=())
    return out.select("vec_id", "pred_large", X.join_list(F.col("pred_groups")).alias("pred_groups"), "pred_digit")


def lr_metrics(spark, sf):
    """Fit all three kinds on four fifths of the vectors and evaluate them on the rest in one metrics table."""
    rows = vectors(spark, sf)
    space = {"groups": ("even", "small", "top")}
    held = F.col("vec_id") % 5 == 0
    model = K.fit(rows.filter(~held), binary=["large"], sets=space, classes={"digit": [str(i) for i in range(10)]})
    out = K.predict(rows.filter(held), model, exclusive=()).withColumns(
        {"true_large": F.col("large").cast("int"), "true_groups": F.col("groups"), "true_digit": F.col("digit")})
    return L.evaluate(out, L.EvalFields(binary=("large",), classes=("digit",), sets=space))


QUERIES = {
    "doc_frequency": doc_frequency, "logodds_heads": logodds_heads, "logodds_weights": logodds_weights,
    "logodds_scores": logodds_scores, "logodds_scores_join": logodds_scores_join, "logodds_predict": logodds_predict,
    "route": route, "prediction_frame": prediction_frame, "outcome_counts": counts, "binary_metrics": binary_metrics,
    "macro_metrics": macro_metrics, "multilabel_metrics": multilabel_metrics, "all_metrics": all_metrics,
    "lang_scores": lang_scores, "confusion": confusion, "metric_compare": metric_compare,
    "routing_decisions": routing_decisions, "decision_rates": decision_rates, "decision_breakdown": decision_breakdown,
    "worst_groups": worst_groups, "error_records": error_records, "error_counts": error_counts,
    "error_hotspots": error_hotspots, "error_examples": error_examples, "expectations": expectations,
    "expectation_summary": expectation_summary, "lr_binary": lr_binary, "lr_multilabel": lr_multilabel,
    "lr_multiclass": lr_multiclass, "lr_metrics": lr_metrics, "lr_heads": lr_heads, "vector_norms": vector_norms, "class_weights": class_weights,
    "vector_decisions": vector_decisions,
}

# --- the same in SQL ---------------------------------------------------------------

_TRUE = {n: S.anykw(w) for n, w in B.TRUE_FLAGS.items()}
_TRAIN = f"""train AS (SELECT doc_id, text, quality, toxic, lang, {', '.join(f'{c} AS {n}' for n, c in _TRUE.items())},
 CASE WHEN lang IN ('fr', 'es') THEN 'latin' ELSE 'germanic' END AS crop,
 CASE lang WHEN 'en' THEN 'question' WHEN 'fr' THEN 'diagnosis' WHEN 'de' THEN 'planning' ELSE 'other' END AS intent,
 CASE WHEN toxic = 1 THEN 'high' WHEN quality = 1 THEN 'low' ELSE 'medium' END AS urgency
 FROM (SELECT *, lower(text) AS low FROM documents JOIN labels USING (doc_id)))"""

_SMALL = [("quality", "true", 0, "quality = 1", 0.5), ("toxic", "true", 0, "toxic = 1", 0.5)] + [
    ("lang", lang, i, f"lang = '{lang}'", 0.5) for i, lang in enumerate(("en", "fr", "de", "es"))]
_SPEC = [("in_scope", "true", 0, "quality = 1", 0.5)]
_SPEC += [(f, "true", 0, f, 0.52 if f == "legal" else 0.5) for f in B.FLAGS]
_SPEC += [("crops", c, i, f"crop = '{c}'", 0.45) for i, c in enumerate(B.SPEC.crops)]
_SPEC += [("topics", t, i, t if t in B.FLAGS else "false", 0.42) for i, t in enumerate(B.SPEC.topics)]
_SPEC += [("intent", t, i, f"intent = '{t}'", 0.5) for i, t in enumerate(B.SPEC.intents)]
_SPEC += [("urgency", t, i, f"urgency = '{t}'", 0.5) for i, t in enumerate(B.SPEC.urgencies)]


def _fit_ctes(heads) -> str:
    """CTEs up to ``heads`` and ``weights``."""
    members = ", ".join(f"CAST(({cond}) AS BIGINT) AS h{i}" for i, (_, _, _, cond, _) in enumerate(heads))
    sums = ", ".join(f"sum(h{i}) AS h{i}" for i in range(len(heads)))
    rows = " UNION ALL ".join(
        f"SELECT {i} AS head, '{f}' AS field, '{label}' AS label, {pos} AS label_pos, CAST({thr} AS DOUBLE) AS threshold, h{i} AS pos, n FROM tot"
        for i, (f, label, pos, _, thr) in enumerate(heads))
    per = " UNION ALL ".join(f"SELECT {i} AS head, feature, df, h{i} AS pos FROM fc" for i in range(len(heads)))
    return f"""{_TRAIN}, marked AS (SELECT doc_id, text, {members} FROM train),
{S.features_cte('marked', 'doc_id, ' + ', '.join(f'h{i}' for i in range(len(heads))), 'mf')},
fc AS (SELECT feature, count(*) AS df, {sums} FROM mf GROUP BY feature),
tot AS (SELECT count(*) AS n, {sums} FROM marked),
heads AS (SELECT head, field, label, label_pos, threshold,
 CAST(round(ln(CAST(pos + 1 AS DOUBLE) / CAST(n - pos + 1 AS DOUBLE)) * 10000) AS BIGINT) AS bias FROM ({rows})),
cand AS (SELECT head, feature, ln(CAST(pos + 1 AS DOUBLE) / CAST(df - pos + 1 AS DOUBLE)) AS w,
 CAST(greatest(pos + 1, df - pos + 1) AS DOUBLE) / CAST(least(pos + 1, df - pos + 1) AS DOUBLE) AS strength FROM ({per})),
weights AS (SELECT head, feature, CAST(round(w * 10000) AS BIGINT) AS weight FROM (
 SELECT *, row_number() OVER (PARTITION BY head ORDER BY strength DESC, feature DESC) AS rn FROM cand WHERE abs(w) >= 0.15) WHERE rn <= 120)"""


_SCORES = f"""{S.features_cte('documents', 'doc_id', 'df_')},
hits AS (SELECT doc_id, head, sum(weight) AS hit FROM df_ JOIN weights USING (feature) GROUP BY ALL),
scores AS (SELECT d.doc_id, h.head, field, label, label_pos, threshold, CAST(bias + coalesce(hit, 0) AS BIGINT) AS total
 FROM documents d CROSS JOIN heads h LEFT JOIN hits ON hits.doc_id = d.doc_id AND hits.head = h.head),
prob AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(CAST(total AS DOUBLE) / 10000.0::DOUBLE))) AS p FROM scores)"""


def _flag_of(name: str) -> str:
    return f"bool_or(p >= threshold) FILTER (field = '{name}')"


def _best_of(name: str) -> str:
    return f"arg_max(label, total * 100 - label_pos) FILTER (field = '{name}')"


_MODEL = f"""model AS (SELECT doc_id, {', '.join(f'{_flag_of(n)} AS m_{n}' for n in B.SPEC.binary)},
 coalesce(list(label ORDER BY label_pos) FILTER (field = 'topics' AND p >= threshold), CAST([] AS VARCHAR[])) AS m_topics,
 {_best_of('intent')} AS m_intent FROM prob GROUP BY doc_id)"""
_JOIN = lambda c: f"CASE WHEN len({c}) = 0 THEN 'none' ELSE array_to_string({c}, ', ') END"
_MT = "CASE WHEN m_in_scope AND len(m_topics) = 0 THEN ['general'] ELSE m_topics END"

_P = "WITH " + S.frame_cte()
_METRIC = lambda num, den: S.safe(num, den)


def _binary_sql(name: str, p: str = "p", kind: str = "binary") -> str:
    tp = f"count(*) FILTER (true_{name} AND pred_{name})"
    fp = f"count(*) FILTER (NOT true_{name} AND pred_{name})"
    fn = f"count(*) FILTER (true_{name} AND NOT pred_{name})"
    right = f"count(*) FILTER (true_{name} = pred_{name})"
    cells = {"accuracy": S.safe(right, "count(*)"), "precision": S.safe(tp, f"{tp} + {fp}"),
             "recall": S.safe(tp, f"{tp} + {fn}"), "f1": S.safe(f"(2 * {tp})", f"(2 * {tp} + {fp} + {fn})")}
    return " UNION ALL ".join(f"SELECT '{name}' AS field, '{m}' AS metric, {x} AS value FROM {p}" for m, x in cells.items())


def _sum_in_order(column: str, order: str = "label") -> str:
    return f"list_reduce(list({column} ORDER BY {order}), lambda a, b: a + b)"


def _class_ctes(p: str = "p", out: str = "") -> str:
    return f"""ls{out} AS (SELECT DISTINCT label FROM (SELECT true_lang AS label FROM {p} UNION ALL SELECT pred_lang FROM {p})),
pl{out} AS (SELECT label, (SELECT count(*) FROM {p} WHERE true_lang = label AND pred_lang = label) AS tp,
 (SELECT count(*) FROM {p} WHERE true_lang <> label AND pred_lang = label) AS fp,
 (SELECT count(*) FROM {p} WHERE true_lang = label AND pred_lang <> label) AS fn FROM ls{out}),
ps{out} AS (SELECT *, {S.safe('tp', 'tp + fp')} AS precision, {S.safe('tp', 'tp + fn')} AS recall,
 {S.safe('2 * tp', '2 * tp + fp + fn')} AS f1 FROM pl{out})"""


def _class_sql(p: str = "p", out: str = "") -> str:
    rows = [f"SELECT 'lang' AS field, 'accuracy' AS metric, {S.safe('count(*) FILTER (true_lang = pred_lang)', 'count(*)')} AS value FROM {p}"]
    rows += [f"SELECT 'lang', '{m}', {_sum_in_order(m)} / CAST(count(*) AS DOUBLE) FROM ps{out}" for m in ("precision", "recall", "f1")]
    return " UNION ALL ".join(rows)


_SPACE = FIELDS.sets["topics"]


def _set_ctes(p: str = "p", out: str = "") -> str:
    has = lambda side, t: f"list_contains({side}_topics, '{t}')"
    rows = " UNION ALL ".join(
        f"SELECT '{t}' AS label, count(*) FILTER ({has('true', t)} AND {has('pred', t)}) AS tp,"
        f" count(*) FILTER (NOT {has('true', t)} AND {has('pred', t)}) AS fp,"
        f" count(*) FILTER ({has('true', t)} AND NOT {has('pred', t)}) AS fn FROM {p}" for t in _SPACE)
    return f"""sl{out} AS (SELECT *, {S.safe('tp', 'tp + fp')} AS precision, {S.safe('tp', 'tp + fn')} AS recall,
 {S.safe('2 * tp', '2 * tp + fp + fn')} AS f1 FROM ({rows})),
sm{out} AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sl{out})"""


def _set_sql(p: str = "p", out: str = "") -> str:
    micro = {"precision": S.safe("tp", "tp + fp"), "recall": S.safe("tp", "tp + fn"),
             "f1": S.safe("2 * tp", "2 * tp + fp + fn"), "micro_f1": S.safe("2 * tp", "2 * tp + fp + fn")}
    rows = [f"SELECT 'topics' AS field, 'accuracy' AS metric, {S.safe('count(*) FILTER (list_sort(true_topics) = list_sort(pred_topics))', 'count(*)')} AS value FROM {p}"]
    rows += [f"SELECT 'topics', '{m}', {x} FROM sm{out}" for m, x in micro.items()]
    rows += [f"SELECT 'topics', 'macro_{m}', {_sum_in_order(m)} / CAST(count(*) AS DOUBLE) FROM sl{out}" for m in ("f1", "precision", "recall")]
    return " UNION ALL ".join(rows)


def _all_sql(p: str = "p", out: str = "") -> str:
    return " UNION ALL ".join([*[_binary_sql(f, p) for f in B.FLAGS], _class_sql(p, out), _set_sql(p, out)])


_DEC_OVER = " OR ".join(f"(pred_{f} AND NOT true_{f})" for f in B.FLAGS)
_DEC_UNDER = " OR ".join(f"(true_{f} AND NOT pred_{f})" for f in B.FLAGS)
_DEC = f"""{_P}, dec AS (SELECT *, CASE WHEN ({_DEC_OVER}) AND ({_DEC_UNDER}) THEN 'mixed' WHEN {_DEC_OVER} THEN 'over'
 WHEN {_DEC_UNDER} THEN 'under' ELSE 'correct' END AS decision FROM p)"""
_RATE = lambda d, total="count(*)": S.ratio(f"count(*) FILTER (decision = '{d}')", total)
_BREAK = f"""{_DEC}, e AS (SELECT decision, 'topic' AS group_name, unnest(CASE WHEN len(true_topics) = 0 THEN ['none'] ELSE true_topics END) AS group_key FROM dec
 UNION ALL SELECT decision, 'lang', true_lang FROM dec UNION ALL SELECT decision, 'source', source FROM dec),
b AS (SELECT group_name, group_key, count(*) AS total, {', '.join(f"count(*) FILTER (decision = '{d}') AS {d}" for d in L.DECISIONS)},
 {', '.join(f"{_RATE(d)} AS {d}_rate" for d in L.DECISIONS)} FROM e GROUP BY ALL)"""


def _error_sql() -> str:
    rows = []
    for pos, f in enumerate(B.FLAGS):
        rows.append(f"""SELECT doc_id, source, {_JOIN('true_topics')} AS topic, {pos} AS label_pos, '{f}' AS label,
 CASE WHEN pred_{f} THEN 'false_positive' ELSE 'false_negative' END AS error_type,
 CAST(CAST(true_{f} AS INT) AS VARCHAR) AS true_value, CAST(CAST(pred_{f} AS INT) AS VARCHAR) AS pred_value FROM p WHERE true_{f} <> pred_{f}""")
    rows.append(f"SELECT doc_id, source, {_JOIN('true_topics')}, 4, 'lang', 'mismatch', true_lang, pred_lang FROM p WHERE true_lang <> pred_lang")
    rows.append(f"SELECT doc_id, source, {_JOIN('true_topics')}, 5, 'topics', 'set_mismatch', {_JOIN('true_topics')}, {_JOIN('pred_topics')} FROM p WHERE list_sort(true_topics) <> list_sort(pred_topics)")
    return " UNION ALL ".join(rows)


_ERR = f"{_P}, err AS ({_error_sql()})"
_GROUPS = lambda names: " UNION ALL ".join(
    f"SELECT '{g}' AS group_name, {g} AS group_key, count(*) AS n FROM err GROUP BY {g}" for g in names)
_PAIRS = ", ".join(f"true_{c}, pred_{c}" for c in B.FLAGS)
_EXP = f"""WITH {S.rules_cte()}, {S.frame_cte()},
x AS (SELECT doc_id, {', '.join(f"CASE WHEN true_lang <> 'es' THEN {c} = true_{c} END AS ok_{c}" for c in EXPECTED)},
 len(list_filter(true_topics, lambda t: NOT list_contains(topics, t))) = 0 AS ok_topics FROM p JOIN r USING (doc_id)),
y AS (SELECT *, {' AND '.join(f'coalesce(ok_{c}, true)' for c in (*EXPECTED, 'topics'))} AS all_passed FROM x)"""

_GIVEN = ", ".join(
    f"1 / (1 + exp(-list_inner_product(v, [CAST((i * 7 + {3 * k}) % 11 - 5 AS DOUBLE) / 10 FOR i IN range(len(v))]))) AS s{k}" for k in range(3))
_TOP = "CASE greatest(s0, s1, s2) WHEN s0 THEN 'one' WHEN s1 THEN 'two' ELSE 'three' END"

ORACLE = {
    "vector_norms": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS place, round(unnest(v) / sqrt(list_inner_product(v, v)), 6) AS part FROM e""",
    "class_weights": """SELECT label, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * CAST(count(*) AS DOUBLE)), 9) AS weight
FROM embeddings GROUP BY label""",
    "vector_decisions": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT vec_id, {_GIVEN} FROM e)
SELECT vec_id, CAST(s0 > 0.5 AS INT) AS flag,
 coalesce(nullif(concat_ws(', ', CASE WHEN s0 >= 0.5 THEN 'one' END, CASE WHEN s1 >= 0.5 THEN 'two' END, CASE WHEN s2 >= 0.5 THEN 'three' END), ''), 'none') AS labels,
 CASE WHEN greatest(s0, s1, s2) >= 0.6 THEN {_TOP} ELSE 'none' END AS exclusive, {_TOP} AS best FROM p""",
    "doc_frequency": f"""WITH {S.features_cte('documents', 'doc_id', 'f')}
SELECT feature, count(*) AS n FROM f GROUP BY feature""",
    "logodds_heads": f"WITH {_fit_ctes(_SPEC)} SELECT head, field, label, label_pos, bias, threshold FROM heads",
    "logodds_weights": f"WITH {_fit_ctes(_SMALL)} SELECT field, label, feature, weight FROM weights JOIN heads USING (head)",
    "logodds_scores": f"WITH {_fit_ctes(_SMALL)}, {_SCORES} SELECT doc_id, field, label, total FROM scores",
    "logodds_scores_join": f"WITH {_fit_ctes(_SMALL)}, {_SCORES} SELECT doc_id, field, label, total FROM scores",
    "logodds_predict": f"""WITH {_fit_ctes(_SMALL)}, {_SCORES}
SELECT doc_id, {_flag_of('quality')} AS quality, {_flag_of('toxic')} AS toxic, {_best_of('lang')} AS lang FROM prob GROUP BY doc_id""",
    "route": f"""WITH {S.rules_cte()}, {_fit_ctes(_SPEC)}, {_SCORES}, {_MODEL}
SELECT doc_id, in_scope, {', '.join(f'in_scope AND (m_{f} OR {f}) AS {f}' for f in B.FLAGS)},
 CASE WHEN in_scope THEN {_JOIN('crops')} ELSE 'none' END AS crops,
 CASE WHEN in_scope THEN {_JOIN(f'list_sort(list_distinct(list_concat({_MT}, topics)))')} ELSE 'none' END AS topics,
 CASE WHEN in_scope AND intent <> 'other' THEN intent ELSE m_intent END AS intent,
 CASE WHEN in_scope THEN urgency ELSE 'low' END AS urgency
FROM r JOIN model USING (doc_id) WHERE {S.strip('text')} <> ''""",
    "prediction_frame": f"""{_P} SELECT doc_id, 'all' AS split, source, {_PAIRS}, true_lang, pred_lang, len(true_topics) AS topic_count,
 {_JOIN('true_topics')} AS true_topics, {_JOIN('pred_topics')} AS pred_topics FROM p""",
    "outcome_counts": f"""{_P}, o AS (
 {' UNION ALL '.join(f"SELECT 'binary' AS kind, '{f}' AS field, NULL AS label, CAST(CAST(true_{f} AS INT) AS VARCHAR) AS t, CAST(CAST(pred_{f} AS INT) AS VARCHAR) AS p FROM p" for f in B.FLAGS)}
 UNION ALL SELECT 'class', 'lang', NULL, true_lang, pred_lang FROM p
 {' '.join(f"UNION ALL SELECT 'set', 'topics', '{t}', CAST(CAST(list_contains(true_topics, '{t}') AS INT) AS VARCHAR), CAST(CAST(list_contains(pred_topics, '{t}') AS INT) AS VARCHAR) FROM p" for t in _SPACE)}
 UNION ALL SELECT 'subset', 'topics', NULL, '1', CAST(CAST(list_sort(true_topics) = list_sort(pred_topics) AS INT) AS VARCHAR) FROM p)
SELECT kind, field, label, t, p, count(*) AS n FROM o GROUP BY ALL""",
    "binary_metrics": _P + " " + " UNION ALL ".join(_binary_sql(f) for f in B.FLAGS),
    "macro_metrics": f"{_P}, {_class_ctes()} {_class_sql()}",
    "multilabel_metrics": f"{_P}, {_set_ctes()} {_set_sql()}",
    "all_metrics": f"{_P}, {_class_ctes()}, {_set_ctes()} {_all_sql()}",
    "lang_scores": f"{_P}, {_class_ctes()} SELECT label, tp, fp, fn, precision, recall, f1 FROM ps",
    "confusion": f"""{_P}, space(label) AS (VALUES {', '.join(f"('{x}')" for x in B.LANG_SPACE)})
SELECT a.label AS true_label, b.label AS pred_label, (SELECT count(*) FROM p WHERE true_lang = a.label AND pred_lang = b.label) AS n
FROM space a CROSS JOIN space b""",
    "metric_compare": f"""{_P}, {S.frame_cte(B.RULES_ALT_FLAGS).replace('p AS', 'q AS', 1)},
{_class_ctes()}, {_set_ctes()}, {_class_ctes('q', '2')}, {_set_ctes('q', '2')},
a AS ({_all_sql()}), b AS ({_all_sql('q', '2')})
SELECT a.field, a.metric, a.value AS model, b.value AS rules,
 CASE WHEN a.value > b.value THEN 'model' WHEN b.value > a.value THEN 'rules' ELSE 'tie' END AS winner, a.value - b.value AS delta
FROM a JOIN b ON a.field = b.field AND a.metric = b.metric WHERE a.metric = CASE WHEN a.field = 'topics' THEN 'micro_f1' ELSE 'f1' END""",
    "routing_decisions": f"{_DEC} SELECT doc_id, decision FROM dec",
    "decision_rates": f"""{_DEC} SELECT {_RATE('correct')} AS exact_match_rate, {_RATE('over')} AS over_trigger_rate,
 {_RATE('under')} AS under_trigger_rate, {_RATE('mixed')} AS mixed_error_rate FROM dec""",
    "decision_breakdown": f"{_BREAK} SELECT * FROM b",
    "worst_groups": f"""{_BREAK} SELECT group_name, position, group_key, total, correct_rate FROM (SELECT *, row_number() OVER (
 PARTITION BY group_name ORDER BY correct_rate, total, group_key) AS position FROM b) WHERE position <= 8""",
    "error_records": f"{_ERR} SELECT * FROM err",
    "error_counts": f"{_ERR} {_GROUPS(['label', 'topic', 'source'])}",
    "error_hotspots": f"""{_ERR}, c AS ({_GROUPS(['topic', 'source'])}) SELECT group_name, position, group_key, n FROM (
 SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY n DESC, group_key) AS position FROM c) WHERE position <= 20""",
    "error_examples": f"""{_ERR}, l AS (SELECT 'all' AS list_name, 50 AS lim, * FROM err UNION ALL SELECT 'false_positive', 10, * FROM err WHERE error_type = 'false_positive'
 UNION ALL SELECT 'false_negative', 10, * FROM err WHERE error_type = 'false_negative')
SELECT list_name, position, doc_id, label, error_type FROM (SELECT *, row_number() OVER (PARTITION BY list_name ORDER BY doc_id, label_pos) AS position FROM l) WHERE position <= lim""",
    "expectations": f"{_EXP} SELECT doc_id, {', '.join(f'ok_{c}' for c in (*EXPECTED, 'topics'))}, all_passed FROM y",
    "expectation_summary": f"{_EXP} SELECT count(*) FILTER (all_passed) AS passed, count(*) AS total FROM y",
}
