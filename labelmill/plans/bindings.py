"""How the test tables play the parts of a labelled corpus and of a log.

``documents`` is the corpus.  Its text truth flags come from one set of words,
the rule predictions from another, so that every decision class occurs.
``events`` is the log: views are inferences, purchases and errors are reviews.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.config import LabelSpec, Lexicon, RuleConfig, Thresholds
from labelmill.functions import text as X
from labelmill.operators.logodds import Head, heads_of
from labelmill.operators.lexicon import first_match, rule_predict

FLAGS = ("legal", "contact", "thermal", "inquiry")
SPEC = LabelSpec(
    domain="in_scope",
    flags=FLAGS,
    crops=("latin", "germanic", "both", "unknown"),
    topics=("legal", "contact", "thermal", "inquiry", "general"),
    intents=("question", "diagnosis", "recommendation", "planning", "monitoring",
             "information_lookup", "comparison", "other"),
    urgencies=("low", "medium", "high"),
)
RULES = RuleConfig(
    spec=SPEC,
    flag_keywords={
        "legal": ("licensed", "#"),
        "contact": (".com", "$"),
        "thermal": ("heat ", "theat"),
        "inquiry": ("what ", "nwha"),
    },
    topic_keywords={
        "legal": ("license", "copyright"),
        "contact": ("@", "*"),
        "thermal": ("heat", "wheat"),
        "inquiry": ("what ", "nwhat"),
    },
    crop_keywords={"latin": ("que ", "los "), "germanic": ("the ", "die ")},
    intent_keywords={
        "diagnosis": ("mit license", "apache"),
        "recommendation": ("free", "worth"),
        "planning": ("$", "1"),
        "monitoring": ("than ", "leur "),
        "information_lookup": ("der ", "ción "),
        "comparison": ("thes ", "une "),
        "question": ("wha", "qu"),
    },
    urgent_keywords=("licensed", "$"),
    soon_keywords=("that ", "pour "),
    negative_hints=("worthless", "&&&"),
    default_topic="general",
    question_mark="|",
)
# A second lexicon over the same labels, for the comparison of two predictors.
RULES_ALT_FLAGS: Lexicon = {
    "legal": ("license", "1"),
    "contact": ("@", "#"),
    "thermal": ("heat", "thea"),
    "inquiry": ("what", "when"),
}
TRUE_FLAGS: Lexicon = {"legal": ("license",), "contact": ("@",), "thermal": ("heat",), "inquiry": ("what",)}
LANGS: Lexicon = {"de": ("die ",), "es": ("los ", "el "), "fr": ("que ",), "en": ("and ", "the ")}
LANG_SPACE = ("de", "es", "fr", "en", "other")
VAGUE = ("of the", "and the", "le la", "der die", "de la")
MODULES = {"legal": "counsel", "contact": "mailer", "thermal": "sensor", "inquiry": "search"}
THRESHOLDS = Thresholds(binary={"legal": 0.52}, sets={"topics": 0.42, "crops": 0.45})
HARD_CHARS = 2000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents."""
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the full rule prediction."""
    return rule_predict(documents(spark, sf), RULES, "text")


def lang_guess(low: Column) -> Column:
    return first_match(low, LANGS, "other")


def frame(spark: SparkSession, sf: str, flags: Lexicon = RULES.flag_keywords, topics: Lexicon = RULES.topic_keywords) -> DataFrame:
    """Prediction frame: truth and predictions of flags, topics and language."""
    low = F.col("__low")
    true = {f"true_{n}": X.any_keyword(low, w) for n, w in TRUE_FLAGS.items()}
    pred = {f"pred_{n}": X.any_keyword(low, w) for n, w in flags.items()}
    picks = {f"__t_{n}": X.any_keyword(low, w) for n, w in topics.items()}
    marked = documents(spark, sf).withColumn("__low", X.lowered(F.col("text"))).withColumns(
        {**true, **pred, **picks, "true_lang": F.col("lang"), "pred_lang": lang_guess(low)})
    listed = lambda prefix: F.array_compact(F.array(*[F.when(F.col(prefix + n), F.lit(n)) for n in FLAGS])).cast("array<string>")
    return marked.withColumns({"true_topics": listed("true_"), "pred_topics": listed("__t_")}).drop("__low", *picks)


def training(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a value for every label field."""
    low = X.lowered(F.col("text"))
    flags = {n: X.any_keyword(low, w) for n, w in TRUE_FLAGS.items()}
    crop = F.when(F.col("lang").isin("fr", "es"), F.lit("latin")).otherwise(F.lit("germanic"))
    rows = labelled(spark, sf).withColumns(flags).withColumns({
        "in_scope": F.col("quality") == 1,
        "crops": F.array(crop),
        "topics": F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in FLAGS])).cast("array<string>"),
        "intent": F.when(F.col("lang") == "en", "question").when(F.col("lang") == "fr", "diagnosis")
        .when(F.col("lang") == "de", "planning").otherwise("other"),
        "urgency": F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 1, "low").otherwise("medium"),
    })
    return rows


def small_heads() -> list[Head]:
    """Two flags and the language as heads."""
    out = [Head("quality", "true", 0, F.col("quality") == 1), Head("toxic", "true", 0, F.col("toxic") == 1)]
    return out + [Head("lang", lang, i, F.col("lang") == lang) for i, lang in enumerate(("en", "fr", "de", "es"))]


def spec_heads() -> list[Head]:
    return heads_of(SPEC, THRESHOLDS)


def log(spark: SparkSession, sf: str) -> DataFrame:
    return as_log(table(spark, sf, "events"))


def as_log(events: DataFrame) -> DataFrame:
    """Events as inference and review log rows; other types stay as they are."""
    kind, value = F.col("event_type"), F.col("value")
    is_view, is_error = kind == "view", kind == "error"
    band = lambda low, high: F.when(value < low, "low").when(value < high, "medium").otherwise("high")
    labels = lambda shift: F.struct(
        band(5.0 + shift, 20.0).alias("level"), (value > 10.0 + shift).alias("large"),
        F.when(value > 30.0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("tags"))
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("interaction_id"),
        F.when(is_view, "inference").when(kind.isin("purchase", "error"), "review").otherwise(kind).alias("entry_type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(is_view, F.col("props")).alias("input"),
        F.when(is_view, labels(0.0)).alias("prediction"),
        F.when(is_view, F.create_map(F.lit("value"), value)).alias("confidence"),
        F.when(kind == "purchase", "correct").when(is_error & (value >= 4.0), "incorrect").alias("user_feedback"),
        F.when(is_error & (value >= 8.0), labels(3.0)).alias("corrected_labels"),
    )
