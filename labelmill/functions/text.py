"""Scalar text, array and math functions, as Column expressions.

All of them stay inside the JVM.  Whitespace is the Unicode class, and word
boundaries are spelled out, because ``\\s`` and ``\\b`` differ between engines.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
# The same class character by character, for trimming without a regex.
SPACE_CHARS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Whitespace runs that are not already one plain space.
UNEVEN_SPACE = rf"[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}&&[^ ]]{SPACE}*| {SPACE}+"
# Everything but ``a-z0-9? `` as ranges: several times faster than ``[^...]``.
OTHER_CHARS = r"[\x00-\x1f!-/:->@-`{-\x{10ffff}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN = "[a-z0-9']+"

# Up to this many keywords become a generated-code OR chain; larger lexicons
# are tested by ``exists`` over one array literal.
OR_CHAIN_LIMIT = 256


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, UNEVEN_SPACE, " ")


def normalize_text(text: Column) -> Column:
    """Strip, lower, collapse whitespace, then drop all but ``a-z0-9? ``."""
    return F.regexp_replace(collapse_spaces(F.lower(strip(text))), OTHER_CHARS, "")


# Fingerprint of texts that are blank after normalisation.
BLANK_KEY = "d41d8cd98f00b204e9800998ecf8427e"


def fingerprint(text: Column) -> Column:
    """128-bit key of a normalised text, so that whole texts are not shuffled.

    Never null (null text gives ''), or joins on it would add a null check that
    evaluates the whole expression a second time.
    """
    return F.coalesce(F.md5(normalize_text(text)), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated pieces; blank text has none."""
    pieces = F.split(strip(text), f"{SPACE}+")
    return F.when(strip(text) == "", F.lit(0)).otherwise(F.size(pieces))


def is_short(text: Column, limit: int = 5) -> Column:
    return word_count(text) <= limit


def phrase_pattern(phrases: Sequence[str]) -> str:
    """Regex that finds any phrase between word boundaries."""
    body = "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases)
    return rf"(^|[^\p{{L}}\p{{N}}_])({body})($|[^\p{{L}}\p{{N}}_])"


def has_phrase(low: Column, phrases: Sequence[str]) -> Column:
    return low.rlike(phrase_pattern(phrases))


def full_match(value: Column, pattern: str) -> Column:
    """Whole-string match; a trailing newline does not slip through."""
    return value.rlike(rf"\A(?:{pattern})\z")


def lowered(text: Column) -> Column:
    """Lower-case text, '' for null.  Tests on it are never null, so joins and
    groupings on their results add no null checks that repeat the tests."""
    return F.coalesce(F.lower(text), F.lit(""))


def any_keyword(low: Column, keywords: Sequence[str]) -> Column:
    """True when some keyword is a literal substring of the lower-case text."""
    words = list(dict.fromkeys(keywords))
    if not words:
        return F.lit(False)
    if len(words) > OR_CHAIN_LIMIT:
        return F.exists(F.array(*map(F.lit, words)), lambda word: low.contains(word))
    return reduce(lambda a, b: a | b, [low.contains(word) for word in words])


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def add_features(df: DataFrame, text: str = "input", out: str = "features", ordered: bool = False) -> DataFrame:
    """Distinct unigrams and ``a_b`` bigrams of ``text``.

    Tokens are projected first: three references keep Catalyst from inlining
    the regex into the per-pair lambda, which would make it quadratic.
    """
    tok = "__tokens"
    tail = F.slice(tok, F.lit(2), F.greatest(F.size(tok) - 1, F.lit(0)))
    pairs = F.array_compact(F.zip_with(tok, tail, lambda a, b: F.concat(a, F.lit("_"), b)))
    features = F.array_distinct(F.concat(F.col(tok), pairs))
    if ordered:
        features = F.array_sort(features)
    return df.withColumn(tok, tokens(F.col(text))).withColumn(out, features).drop(tok)


def sigmoid(x: Column) -> Column:
    """``exp`` overflows to Infinity in the JVM, which gives 0.0 as wanted."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_ratio(pos: Column, neg: Column) -> Column:
    """Smoothed log ratio ``log((pos+1)/(neg+1))``."""
    return F.log((pos + 1) / (neg + 1))


def clamp_up(x: Column, floor: float) -> Column:
    return F.greatest(x, F.lit(floor))


def clamp_down(x: Column, ceiling: float) -> Column:
    return F.least(x, F.lit(ceiling))


def ratio(num: Column, den: Column) -> Column:
    """``num / max(den, 1)`` as double."""
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def sorted_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def default_list(values: Column, fallback: str = "none") -> Column:
    """The list itself, or ``[fallback]`` when it is empty or null."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, values).otherwise(F.array(F.lit(fallback)))


def join_list(values: Column, fallback: str = "none", sep: str = ", ") -> Column:
    return F.coalesce(F.nullif(F.array_join(values, sep), F.lit("")), F.lit(fallback))


def lists_differ(a: Column, b: Column, ordered: bool = False) -> Column:
    """Null-safe inequality of lists, as multisets unless ``ordered``."""
    if not ordered:
        a, b = F.array_sort(a), F.array_sort(b)
    return ~a.eqNullSafe(b)


def contains_all(actual: Column, expected: Column) -> Column:
    return F.size(F.array_except(expected, actual)) == 0


def label_array(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(label) for label in labels]).cast("array<string>")


def multi_hot(values: Column, space: Sequence[str], strict: bool = True) -> Column:
    """0/1 vector in label-space order.  A label outside the space raises when
    ``strict``; otherwise find it beforehand with :func:`unknown_labels`."""
    vector = F.transform(label_array(space), lambda label: F.array_contains(values, label).cast("int"))
    if not strict:
        return vector
    return F.when(F.size(unknown_labels(values, space)) == 0, vector).otherwise(
        F.raise_error(F.concat(F.lit("labels outside the space: "), join_list(unknown_labels(values, space))))
    )


def decode_hot(vector: Column, space: Sequence[str]) -> Column:
    return F.filter(label_array(space), lambda label, i: F.get(vector, i) == 1)


def unknown_labels(values: Column, space: Sequence[str]) -> Column:
    return F.array_except(values, label_array(space))


def label_vector(value: Column, is_list: bool) -> Column:
    """Labels of a field as strings, whether it holds a list or one value."""
    return value.cast("array<string>") if is_list else F.array(value.cast("string"))


def fill_template(template: Column, **slots: Column) -> Column:
    """Replace each ``{name}`` in the template by the column given for it."""
    out = template
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def cyclic_pick(choices: Sequence[str], index: Column) -> Column:
    return F.element_at(label_array(choices), (F.pmod(index, F.lit(len(choices))) + 1).cast("int"))


def build_id(number: Column, prefix: str = "route_", width: int = 6) -> Column:
    """Zero-padded id; numbers wider than ``width`` keep all their digits."""
    digits = number.cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))
    return F.concat(F.lit(prefix), padded)


def id_number(row_id: Column) -> Column:
    return F.split_part(row_id, F.lit("_"), F.lit(2)).cast("bigint")


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def parse_list(raw: Column, current: Column) -> Column:
    """Comma list with blanks dropped; blank input keeps the current value."""
    parsed = F.filter(F.transform(F.split(raw, ","), strip), lambda item: item != "")
    return F.when(F.coalesce(strip(raw), F.lit("")) == "", current).otherwise(parsed)


def parse_bool(raw: Column, current: Column) -> Column:
    """``1/true/t/yes/y`` is true, other text false, blank keeps the current."""
    token = F.lower(strip(F.coalesce(raw, F.lit(""))))
    return F.when(token == "", current).otherwise(token.isin("1", "true", "t", "yes", "y"))


def parse_text(raw: Column, current: Column) -> Column:
    return F.coalesce(F.nullif(strip(raw), F.lit("")), current)
