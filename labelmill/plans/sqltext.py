"""SQL building blocks for the checks: the bindings again, in plain SQL."""

from __future__ import annotations

from labelmill.config import Lexicon
from labelmill.plans import bindings as B

WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def anykw(words: tuple[str, ...], low: str = "low") -> str:
    return "(" + " OR ".join(f"contains({low}, {quoted(w)})" for w in words) + ")"


def first_match(lexicon: Lexicon, default: str, low: str = "low") -> str:
    whens = " ".join(f"WHEN {anykw(words, low)} THEN {quoted(label)}" for label, words in lexicon.items())
    return f"CASE {whens} ELSE {default} END"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({strip(x)}), '{WS}+', ' ', 'g'), '[^a-z0-9? ]', '', 'g')"


def words(x: str) -> str:
    return rf"CASE WHEN {strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(x)}, '{WS}+')) END"


def phrase(low: str, phrases: tuple[str, ...]) -> str:
    return rf"regexp_matches({low}, '(^|[^\p{{L}}\p{{N}}_])({'|'.join(phrases)})($|[^\p{{L}}\p{{N}}_])')"


def picked(pairs: list[tuple[str, str]]) -> str:
    """List of the names whose condition holds."""
    items = ", ".join(f"CASE WHEN {cond} THEN {quoted(name)} END" for name, cond in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def safe(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"


def ratio(num: str, den: str) -> str:
    return f"CAST({num} AS DOUBLE) / CAST(greatest({den}, 1) AS DOUBLE)"


def rules_cte(cfg=B.RULES) -> str:
    """CTEs ``low``, ``m`` and ``r``; ``r`` has the full rule prediction."""
    flags = ", ".join(f"{anykw(w)} AS f_{n}" for n, w in cfg.flag_keywords.items())
    topics = ", ".join(f"{anykw(w)} AS t_{n}" for n, w in cfg.topic_keywords.items())
    crops = ", ".join(f"{anykw(w)} AS c_{n}" for n, w in cfg.crop_keywords.items())
    hits = " OR ".join([f"f_{n}" for n in cfg.flag_keywords] + [f"t_{n}" for n in cfg.topic_keywords]
                       + [f"c_{n}" for n in cfg.crop_keywords])
    topic_any = " OR ".join(f"t_{n}" for n in cfg.topic_keywords)
    listed = picked([(n, f"t_{n}") for n in cfg.topic_keywords])
    out_flags = ", ".join(f"(in_scope AND f_{n}) AS {n}" for n in cfg.flag_keywords)
    no_intent = f"CASE WHEN NOT in_scope AND contains(low, {quoted(cfg.question_mark)}) THEN 'question' ELSE 'other' END"
    a, b = cfg.crop_keywords
    return f"""low AS (SELECT doc_id, text, lang, source, n_chars, lower(text) AS low FROM documents),
m AS (SELECT *, {flags}, {topics}, {crops} FROM low),
d AS (SELECT *, (({hits}) AND NOT {anykw(cfg.negative_hints)}) AS in_scope FROM m),
r AS (SELECT doc_id, text, low, lang, source, n_chars, in_scope, {out_flags},
  CASE WHEN c_{a} AND c_{b} THEN ['both'] WHEN c_{a} THEN ['{a}'] WHEN c_{b} THEN ['{b}']
       WHEN in_scope THEN ['unknown'] ELSE CAST([] AS VARCHAR[]) END AS crops,
  CASE WHEN in_scope AND NOT ({topic_any}) THEN ['{cfg.default_topic}'] ELSE {listed} END AS topics,
  {first_match(cfg.intent_keywords, no_intent)} AS intent,
  CASE WHEN {anykw(cfg.urgent_keywords)} THEN 'high' WHEN {anykw(cfg.soon_keywords)} THEN 'medium'
       WHEN in_scope THEN 'medium' ELSE 'low' END AS urgency
 FROM d)"""


def frame_cte(flags: Lexicon | None = None) -> str:
    """CTE ``p``: truth and predictions of flags, topics and language."""
    flags = flags or B.RULES.flag_keywords
    true = ", ".join(f"{anykw(w)} AS true_{n}" for n, w in B.TRUE_FLAGS.items())
    pred = ", ".join(f"{anykw(w)} AS pred_{n}" for n, w in flags.items())
    true_topics = picked([(n, anykw(w)) for n, w in B.TRUE_FLAGS.items()])
    pred_topics = picked([(n, anykw(w)) for n, w in B.RULES.topic_keywords.items()])
    lang = first_match(B.LANGS, "'other'")
    return f"""p AS (SELECT doc_id, source, n_chars, lang AS true_lang, {lang} AS pred_lang, {true}, {pred},
  {true_topics} AS true_topics, {pred_topics} AS pred_topics
 FROM (SELECT *, lower(text) AS low FROM documents))"""


FEATURES = """list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])))"""


def features_cte(source: str, columns: str, name: str) -> str:
    """CTE ``name``: one row per document of ``source`` and distinct feature."""
    return f"""{name} AS (SELECT {columns}, unnest({FEATURES}) AS feature
 FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9'']+') AS t FROM {source}))"""
