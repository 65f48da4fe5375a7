"""Final routing: token model and rules combined, in one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.config import RuleConfig
from labelmill.functions import text as X
from labelmill.operators import logodds as H
from labelmill.operators.corpus import label_names, labels_schema
from labelmill.operators.lexicon import rule_predict
from labelmill.operators.scale import cut_lineage

# Confidence floors where a rule decides, and the ceiling for
# flags outside the domain.
DOMAIN_FLOOR = 0.85
FLAG_FLOOR = 0.80
CROP_FLOOR = 0.82
TOPIC_FLOOR = 0.78
CLASS_FLOOR = 0.72
OUTSIDE_CEILING = 0.20


def split_blank(df: DataFrame, text: str = "input") -> tuple[DataFrame, DataFrame]:
    """Rows with text (stripped), and rejected blank or null rows."""
    stripped = df.withColumn(text, X.strip(F.col(text)))
    blank = F.coalesce(F.col(text), F.lit("")) == ""
    return stripped.filter(~blank), stripped.filter(blank)


def _raise_labels(scores: Column, labels: Column, floor: float) -> Column:
    return F.transform_values(
        scores, lambda label, value: F.when(F.array_contains(labels, label), X.clamp_up(value, floor)).otherwise(value))


def combine(df: DataFrame, cfg: RuleConfig, rule: str = "rule_", model: str = "model_", conf: str = "conf_") -> DataFrame:
    """Override model decisions by rules.

    The rules alone decide the domain.  Inside it, flags are model OR rule,
    crops and urgency the rule's, topics the union, and the intent the rule's
    unless that is the fallback.  Outside it everything is off, urgency is
    lowest, and the intent stays the model's.
    """
    spec = cfg.spec
    inside = F.col(rule + spec.domain)
    out: dict[str, Column] = {spec.domain: inside}
    scores: dict[str, Column] = {}
    r = lambda name: F.col(rule + name)
    m = lambda name: F.col(model + name)
    c = lambda name: F.col(conf + name)

    scores[spec.domain] = F.when(inside, X.clamp_up(c(spec.domain), DOMAIN_FLOOR)) \
        .otherwise(X.clamp_down(c(spec.domain), OUTSIDE_CEILING))
    for flag in spec.flags:
        out[flag] = inside & (m(flag) | r(flag))
        scores[flag] = F.when(inside & r(flag), X.clamp_up(c(flag), FLAG_FLOOR)) \
            .when(inside, c(flag)).otherwise(X.clamp_down(c(flag), OUTSIDE_CEILING))
    nothing = X.label_array([])
    out["crops"] = F.when(inside, r("crops")).otherwise(nothing)
    out["topics"] = F.when(inside, X.sorted_union(m("topics"), r("topics"))).otherwise(nothing)
    named = r("intent") != cfg.other_intent
    out["intent"] = F.when(inside & named, r("intent")).otherwise(m("intent"))
    out["urgency"] = F.when(inside, r("urgency")).otherwise(F.lit(cfg.urgency_levels[0]))
    scores["crops"] = F.when(inside, _raise_labels(c("crops"), r("crops"), CROP_FLOOR)).otherwise(c("crops"))
    scores["topics"] = F.when(inside, _raise_labels(c("topics"), r("topics"), TOPIC_FLOOR)).otherwise(c("topics"))
    scores["intent"] = F.when(inside & named, _raise_labels(c("intent"), F.array(r("intent")), CLASS_FLOOR)) \
        .otherwise(c("intent"))
    scores["urgency"] = F.when(inside, _raise_labels(c("urgency"), F.array(r("urgency")), CLASS_FLOOR)) \
        .otherwise(c("urgency"))
    kept = [name for name in df.columns if not name.startswith((rule, model, conf))]
    return df.select(*kept, *[v.alias(k) for k, v in out.items()], *[v.alias(conf + k) for k, v in scores.items()])


def with_model_default(df: DataFrame, cfg: RuleConfig, model: str = "model_") -> DataFrame:
    """The model's own fallback topic for domain rows where no topic passes."""
    empty = F.size(model + "topics") == 0
    return df.withColumn(model + "topics", F.when(
        F.col(model + cfg.spec.domain) & empty, X.label_array([cfg.default_topic])).otherwise(F.col(model + "topics")))


def round_confidence(df: DataFrame, cfg: RuleConfig, conf: str = "conf_", digits: int = 4) -> DataFrame:
    rounded = {conf + name: F.round(conf + name, digits) for name in cfg.spec.binary}
    for name in (*cfg.spec.sets, *cfg.spec.classes):
        rounded[conf + name] = F.transform_values(conf + name, lambda _, v: F.round(v, digits))
    return df.withColumns(rounded)


def route(df: DataFrame, model: H.TokenModel | H.Scorer, cfg: RuleConfig, text: str = "input") -> DataFrame:
    """Full prediction per text, with ``conf_*`` columns, for models of any size.

    A model of ordinary size becomes a projection, on batch and streaming frames
    alike; a larger one is joined, with the same result.  A stream cannot be
    joined and gathered per row, so there :func:`live.route_and_log` routes
    each batch.  Blank texts have to be split off with :func:`split_blank` first.
    """
    scorer = model if isinstance(model, H.Scorer) else H.compile_model(model)
    if scorer is None:
        keyed = cut_lineage(df.withColumn("__key", F.monotonically_increasing_id()))
        return route_join(keyed, model, cfg, "__key", text).drop("__key")
    return _finish(H.score_inline(df, scorer, text), scorer, cfg, text)


def route_join(df: DataFrame, model: H.TokenModel, cfg: RuleConfig, key: str, text: str = "input") -> DataFrame:
    """Same result for models of any size; ``key`` has to be unique."""
    sums, heads = H.score_arrays(df, model, key, text)
    return _finish(df.join(sums, key), H.Scorer(heads, F.lit(None), ""), cfg, text)


def _finish(scored: DataFrame, scorer: H.Scorer, cfg: RuleConfig, text: str) -> DataFrame:
    known = scored.withColumn("score_probs", H.probabilities())
    decided = H.add_decisions(H.add_confidence(known, scorer), scorer).drop("score_sums", "score_probs")
    with_rules = rule_predict(with_model_default(decided, cfg), cfg, text, "rule_")
    return combine(round_confidence(with_rules, cfg), cfg)


def to_events(routed: DataFrame, cfg: RuleConfig, text: str = "input", event_id: Column | None = None,
              at: Column | None = None) -> DataFrame:
    """Routed rows as inference log events.

    Pass ``event_id`` and ``at`` for reproducible events; by default the id is
    random and the timestamp is now, in ISO-8601 UTC.
    """
    spec = cfg.spec
    new_id = F.replace(F.uuid(), F.lit("-"), F.lit("")) if event_id is None else event_id
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00") if at is None else at
    names = [spec.domain, *spec.flags, "crops", "topics", "intent", "urgency"]
    confidence = F.struct(*[F.col(f"conf_{name}").alias(name) for name in names])
    labels = F.struct(*[F.col(name) for name in label_names(spec)])
    with_id = routed.withColumn("__id", new_id)
    return with_id.select(
        F.col("__id").alias("id"), F.col("__id").alias("interaction_id"), F.lit("inference").alias("entry_type"),
        stamp.alias("timestamp"), F.col(text).alias("input"), labels.alias("prediction"),
        confidence.alias("confidence"), F.lit(None).cast("string").alias("user_feedback"),
        F.lit(None).cast(labels_schema(spec)).alias("corrected_labels"), F.lit(None).cast("string").alias("review_notes"))
