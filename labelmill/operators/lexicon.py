"""Rule classification from keyword lexicons.

The text is lowered once and each lexicon label is matched once; all decisions
are then plain boolean expressions over those match columns, in one narrow
stage without joins or Python.  Lexicons of thousands of keywords are tables
instead, found through an index of their grams.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.config import Lexicon, RuleConfig
from labelmill.functions import text as X
from labelmill.operators.scale import cut_lineage

# Functions that run in tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _or(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def match_columns(low: Column, lexicon: Lexicon, prefix: str) -> dict[str, Column]:
    """One boolean per lexicon label, named ``prefix + label``."""
    return {prefix + label: X.any_keyword(low, words) for label, words in lexicon.items()}


def first_match(low: Column, lexicon: Lexicon, default: Column | str) -> Column:
    """Label of the first lexicon entry that matches, by lexicon order."""
    fallback = F.lit(default) if isinstance(default, str) else default
    whens = [F.when(X.any_keyword(low, words), F.lit(label)) for label, words in lexicon.items()]
    return F.coalesce(*whens, fallback)


def all_matches(matches: dict[str, Column], prefix: str) -> Column:
    """Labels whose match column is true, in lexicon order."""
    picks = [F.when(column, F.lit(name.removeprefix(prefix))) for name, column in matches.items()]
    return F.array_compact(F.array(*picks)).cast("array<string>")


def resolve_exclusive(has: dict[str, Column], both: str, unknown: str, domain: Column) -> Column:
    """Both of two labels, else the one that matches, else unknown in domain."""
    (first, has_first), (second, has_second) = has.items()
    return (
        F.when(has_first & has_second, X.label_array([both]))
        .when(has_first, X.label_array([first]))
        .when(has_second, X.label_array([second]))
        .when(domain, X.label_array([unknown]))
        .otherwise(X.label_array([]))
    )


def rule_predict(df: DataFrame, cfg: RuleConfig, text: str = "input", prefix: str = "") -> DataFrame:
    """Add the full rule prediction: domain flag, routing flags, crops, topics,
    intent and urgency, each named ``prefix + field``."""
    low = F.col("__low")
    flags = match_columns(low, cfg.flag_keywords, "__f_")
    topics = match_columns(low, cfg.topic_keywords, "__t_")
    crops = match_columns(low, cfg.crop_keywords, "__c_")
    matched = (
        df.withColumn("__low", X.lowered(F.col(text)))
        .withColumns({**flags, **topics, **crops})
    )
    hit = _or([F.col(name) for name in (*crops, *topics, *flags)])
    matched = matched.withColumn("__dom", hit & ~X.any_keyword(low, cfg.negative_hints))

    domain = F.col("__dom")
    low_level, mid_level, high_level = cfg.urgency_levels
    listed = all_matches({name: F.col(name) for name in topics}, "__t_")
    no_intent = F.when(
        ~domain & low.contains(cfg.question_mark), F.lit(cfg.question_intent)
    ).otherwise(F.lit(cfg.other_intent))
    out = {prefix + cfg.spec.domain: domain}
    out |= {prefix + flag: domain & F.col("__f_" + flag) for flag in cfg.flag_keywords}
    out[prefix + "crops"] = resolve_exclusive(
        {name.removeprefix("__c_"): F.col(name) for name in crops}, cfg.crop_both, cfg.crop_unknown, domain
    )
    out[prefix + "topics"] = F.when(
        domain & ~_or([F.col(name) for name in topics]), X.label_array([cfg.default_topic])
    ).otherwise(listed)
    out[prefix + "intent"] = first_match(low, cfg.intent_keywords, no_intent)
    out[prefix + "urgency"] = (
        F.when(X.any_keyword(low, cfg.urgent_keywords), F.lit(high_level))
        .when(X.any_keyword(low, cfg.soon_keywords), F.lit(mid_level))
        .when(domain, F.lit(mid_level))
        .otherwise(F.lit(low_level))
    )
    helpers = ["__low", "__dom", *flags, *topics, *crops]
    return matched.withColumns(out).drop(*helpers)


def lexicon_rows(lexicon: Lexicon, name: str) -> list[tuple[str, str, int, str]]:
    """Lexicon as table rows ``(lexicon, label, label_pos, keyword)``."""
    return [(name, label, pos, word) for pos, (label, words) in enumerate(lexicon.items()) for word in words]


def lexicon_from_rows(rows: list[tuple[str, str, int, str]]) -> Lexicon:
    """Inverse of :func:`lexicon_rows`, for lexicons kept as small tables."""
    out: dict[str, list[str]] = {}
    for _, label, _, word in sorted(rows, key=lambda row: row[2]):
        out.setdefault(label, []).append(word)
    return {label: tuple(words) for label, words in out.items()}


# --- lexicons of any size --------------------------------------------------------

#: Bytes of the shortest grams that lead from a text to keywords; shorter keywords are grams themselves.
GRAM = 6

#: How often that may double: a keyword is found by the longest grams that fit into it.
DOUBLINGS = 3

#: Bits per gram of the filter for grams that no keyword is found by, and the most bits it has (1 MB).
FILTER_BITS = 32
MAX_FILTER_BITS = 1 << 23

#: Bytes of text that a task hashes at once.
WINDOW = 1 << 20

_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def gram_size(n_bytes: Column | int, size: int = GRAM, doublings: int = DOUBLINGS) -> Column:
    """Bytes of the grams by which a keyword of ``n_bytes`` is found."""
    fitting = F.lit(n_bytes) if isinstance(n_bytes, int) else n_bytes
    return reduce(lambda out, n: F.when(fitting >= n, F.lit(n)).otherwise(out), [size << k for k in range(doublings + 1)], fitting)


def _hashed(data: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each size, 64-bit codes of the grams of so many bytes at every place of ``data``."""
    with np.errstate(over="ignore"):
        one = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
        codes, length, wanted = one, 1, set(sizes)
        while length <= len(data) and wanted:
            if length in wanted:
                mixed = (codes ^ (codes >> np.uint64(29)) ^ np.uint64(length)) * np.uint64(_MIX)
                yield length, mixed ^ (mixed >> np.uint64(32))
                wanted.remove(length)
            # One byte more, or twice as many if no wanted size is below that.
            step = length if not any(n < 2 * length for n in wanted) else 1
            if length + step > len(data):
                return
            power = np.uint64(pow(_BASE, step, 1 << 64))
            codes = codes[:len(codes) - step] * power + (codes if step > 1 else one)[length:length + len(codes) - step]
            length += step


def _different(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    return rows[first], codes[first]


def _gram_rows(sizes: Sequence[int] | None, bits: np.ndarray | None = None):
    """Rows (key, text) as rows (key, code): the different grams of every text.

    The sizes are given, or there is a third column with one per row.  Codes
    that the filter ``bits`` rules out are left out.
    """
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = None if bits is None else np.unpackbits(bits, bitorder="little").view(bool)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            own = None if sizes is not None else batch.column(2).to_numpy(zero_copy_only=False)
            lengths = sorted(set(sizes if own is None else own.tolist()))
            found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for at in range(int(starts[0]), int(starts[-1]), WINDOW):
                here = data[at:min(at + WINDOW + lengths[-1] - 1, int(starts[-1]))]
                for n, codes in _hashed(here, lengths):
                    codes = codes[:WINDOW]
                    if passes is None:
                        hit = np.arange(len(codes))
                    else:
                        last = np.uint64(len(passes) - 1)
                        hit = np.flatnonzero(passes[codes & last])
                        hit = hit[passes[codes[hit] >> np.uint64(40) & last]]
                    row = np.searchsorted(starts, hit + at, "right") - 1
                    inside = hit + at + n <= starts[row + 1]
                    if own is not None:
                        inside &= own[row] == n
                    found.append(_different(row[inside], codes[hit[inside]].view(np.int64)))
            rows, codes = _different(*map(np.concatenate, zip(*found)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(codes)], names=[batch.schema.names[0], "gram"])

    return coded


def keyword_index(keywords: DataFrame, keyword: str = "keyword", size: int = GRAM) -> DataFrame:
    """``gram, keyword``: every different keyword under that of its grams which the fewest keywords have.

    A gram is a 64-bit code of the bytes of a substring, see :func:`gram_size`.
    Null and empty keywords are left out.
    """
    words = keywords.select(F.col(keyword).alias("keyword")).filter("keyword <> ''").distinct()
    sized = words.select("keyword", F.col("keyword").alias("text"), gram_size(F.octet_length("keyword"), size).alias("size"))
    pairs = cut_lineage(sized.mapInArrow(_gram_rows(None), "keyword string, gram long"))
    spread = pairs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(spread, "gram").groupBy("keyword").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("gram", "keyword")


def gram_filter(index: DataFrame, max_bits: int = MAX_FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the index's grams, two bits each, as bytes; Spark sets the bits, and at most ``max_bits`` come to the driver."""
    bits, wanted = 1024, index.select("gram").distinct().count() * FILTER_BITS
    while bits < min(wanted, max_bits):
        bits *= 2
    places = F.array(F.col("gram"), F.shiftrightunsigned("gram", 40))
    place = index.select(F.explode(F.transform(places, lambda p: p.bitwiseAND(F.lit(bits - 1)))).alias("place"))
    set_bits = F.bit_or(F.expr("shiftleft(1L, CAST(place % 64 AS INT))")).alias("bits")
    words = np.zeros(bits // 64, "<i8")
    for r in place.groupBy(F.expr("CAST(place DIV 64 AS INT)").alias("word")).agg(set_bits).collect():
        words[r["word"]] = r["bits"]
    return words.view(np.uint8)


def keyword_pairs(texts: DataFrame, keywords: DataFrame, key: str, text: str = "input", keyword: str = "keyword", size: int = GRAM) -> DataFrame:
    """``__key, __word``: texts and the different keywords whose gram they have, which may still not occur in them.

    The texts' grams are hashed in windows of bounded size, and those that a
    filter rules out go no further.
    """
    index = cut_lineage(keyword_index(keywords, keyword, size))
    # As many sizes as there are short ones and doublings, at most.
    sizes = [r.n for r in index.select(gram_size(F.octet_length("keyword"), size).alias("n")).distinct().collect()] or [size]
    schema = T.StructType([T.StructField("__key", texts.schema[key].dataType), T.StructField("gram", T.LongType())])
    low = texts.select(F.col(key).alias("__key"), X.lowered(F.col(text)).alias("__low"))
    met = low.mapInArrow(_gram_rows(sizes, gram_filter(index)), schema)
    # A keyword has one gram, and a text each gram once, so no pair comes twice.
    return met.join(index, "gram").select("__key", F.col("keyword").alias("__word"))


def keyword_hits(texts: DataFrame, keywords: DataFrame, key: str, text: str = "input", keyword: str = "keyword", size: int = GRAM) -> DataFrame:
    """``key`` and the columns of ``keywords``: one row per text and keyword row whose keyword is a literal substring of the lower-case text.

    For lexicons too large for :func:`match_columns`, with the same matches.
    ``key`` has to be unique and not null.  Texts meet keywords only through a
    gram of both, which for long keywords is long, so few meet in vain; what
    meets is checked on the whole text.  Null texts are empty; null and empty
    keywords match nothing, and repeated keyword rows give a row each.
    """
    pairs = keyword_pairs(texts, keywords, key, text, keyword, size)
    low = texts.select(F.col(key).alias("__key"), X.lowered(F.col(text)).alias("__low"))
    found = pairs.join(low, "__key").filter(F.contains("__low", "__word")).select(F.col("__key").alias(key), "__word")
    return found.join(keywords, F.col("__word") == F.col(keyword)).drop("__word")
