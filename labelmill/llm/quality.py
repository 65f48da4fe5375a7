"""Document quality by supervised subword embeddings.

A word has a vector for itself and one for each of its character n-grams, all
from one hashed table.  A document is the average of its words, a word the
average of its vectors, and a softmax layer over the average says how likely
each class is.  Vectors and layer are learned together by stochastic gradient
descent in numpy, on a bounded sample of labelled documents.

An average passes through a linear layer word by word.  Scoring therefore needs
one number per word, found once for the different words of many texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelmill.llm.common import picked, slices, split_words, whole_text
from labelmill.operators.scale import cut_lineage, top_k

#: Labelled documents per class that training reads at most, chosen by a hash of their ids.
SAMPLE_PER_CLASS = 1500

BUCKETS = 1 << 16
DIMENSIONS = 16
NGRAMS = (3, 4, 5)
#: Steps of training, a document each; small samples are passed over more often.
STEPS = 18_000
RATE = 0.1
DECAY = 0.01
BIAS_SHARE = 0.1
THRESHOLD = 0.7

@dataclass
class Model:
    """``parts``: what each hashed vector adds to the log-odds; ``bias``: what they start from."""

    parts: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


#: Multipliers of the hashes; odd, so that no two characters of a gram are taken for others by it.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bucket(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Table rows of hashes; every kind of feature has a salt of its own."""
    x = hashes + np.uint64(salt * int(_MIX) % 2**64)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return (x >> np.uint64(40)).astype(np.int64) % BUCKETS


#: Table row of a word n-gram of one and the same word.
SAME = int(_bucket(np.zeros(1, np.uint64), 99)[0])


#: Bytes of text that a task scores at once.
SLICE_BYTES = 4_000_000

#: Words whose n-grams are hashed at once, about 1 KB each.
WORDS_AT_ONCE = 16_384


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of words, and where each word's end: its own row and those of its character n-grams with end marks."""
    parts = [_buckets_of(words[at:at + WORDS_AT_ONCE]) for at in range(0, len(words), WORDS_AT_ONCE)]
    sizes = np.concatenate([np.empty(0, np.int64), *(np.diff(ends, prepend=0) for _, ends in parts)])
    return np.concatenate([np.empty(0, np.int32), *(rows for rows, _ in parts)]), np.cumsum(sizes)


def _buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for a bounded number of words: their n-grams are windows over one row of code points."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = ends[word] - np.arange(len(points))
    place = (sizes[word] - left).astype(np.uint64)
    mixed = (points + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    spread = (place + np.uint64(1)) * _STEP
    whole = np.add.reduceat(mixed * (spread | np.uint64(1)), ends - sizes) if len(words) else np.empty(0, np.uint64)
    rows, owners = [_bucket(whole, 1)], [np.arange(len(words))]
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        gram = np.zeros(len(at), np.uint64)
        for k in range(n):
            gram = gram * _STEP + mixed[at + k]
        rows.append(_bucket(gram, n))
        owners.append(word[at])
    owner = np.concatenate(owners)
    return np.concatenate(rows)[np.argsort(owner, kind="stable")].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(words)))


def _repeats(codes: np.ndarray, starts: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Words of each text that repeat the one before them."""
    same = np.concatenate([[False], codes[1:] == codes[:-1]]) & real[codes] if len(codes) else np.empty(0, bool)
    inside = starts[:-1][starts[:-1] < len(codes)]
    same[inside] = False
    before = np.concatenate([[0], np.cumsum(same)])
    return before[starts[1:]] - before[starts[:-1]]


def _features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Table rows and weights of every document; the weights of a document add up to 1."""
    words, codes, starts = split_words(pa.array(texts, pa.string()))
    real = np.array([bool(w) for w in words], bool)
    rows, ends = buckets_of(words)
    count = np.diff(np.concatenate([[0], ends]))
    out = []
    for a, b, again in zip(starts[:-1], starts[1:], _repeats(codes, starts, real)):
        of = codes[a:b][real[codes[a:b]]]
        n = len(of) + int(again)
        at, _ = picked(ends, of)
        mine = np.concatenate([rows[at], np.full(min(1, again), SAME)])
        share = np.concatenate([np.repeat(1 / count[of], count[of]), [again] * min(1, again)]) / max(1, n)
        unique, where = np.unique(mine, return_inverse=True)
        out.append((unique.astype(np.int32), np.bincount(where, weights=share, minlength=len(unique)).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[int], seed: int = 42) -> Model:
    """Fit the vectors and the softmax layer.  Without texts, every score is 0.5."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((2, DIMENSIONS), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    docs, classes = _features(texts), np.asarray(labels)
    weight = {c: len(classes) / (2 * max(1, int((classes == c).sum()))) for c in (0, 1)}
    for step in range(0, STEPS if docs else 0, max(1, len(docs))):
        for k, d in enumerate(rng.permutation(len(docs))):
            rate = RATE * max(0.0, 1 - (step + k) / STEPS)
            rows, weights = docs[d]
            if not len(rows):
                continue
            vector = weights @ table[rows]
            scores = layer @ vector + bias
            chance = np.exp(scores - scores.max())
            error = chance / chance.sum()
            error[classes[d]] -= 1
            error *= weight[int(classes[d])]
            back = error @ layer
            layer -= rate * (np.outer(error, vector) + DECAY * layer)
            bias -= rate * BIAS_SHARE * error
            # Shares of a long text are small; measured by their squares, each document's average takes a step of one size.
            table[rows] -= np.outer(rate * weights / float(weights @ weights), back).astype(np.float32)
    return Model((table @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``doc_id, text, quality`` of labelled documents that are not held out, at most ``per_class`` for each class.

    Only labels of ids that ``docs`` has are ranked, and an id gives one text,
    that of the least hash, so that no repeated id makes the sample larger.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    wanted = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("quality")).distinct()
        .join(texts.select(F.col("doc_id").alias("__id")), "__id", "left_semi")
    )
    wanted = cut_lineage(wanted)
    # The smallest hashes of a class are its sample.  How many rows it has tells below which
    # hash they surely lie, so only a few times the sample is ranked.
    mark = F.shiftrightunsigned(F.xxhash64("__id"), 1)
    below = {r["quality"]: min(1.0, 4 * (per_class + 100) / r["n"]) for r in wanted.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = {c: int(share * 2**62) * 2 for c, share in below.items()}
    able = wanted.filter(mark <= F.when(F.col("quality") == 0, F.lit(min(ends.get(0, 0), 2**63 - 1))).otherwise(F.lit(min(ends.get(1, 0), 2**63 - 1))))
    chosen = top_k(able, ["quality"], [mark, F.col("__id")], per_class)
    found = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    return found.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Train on the bounded sample; ids only order it, so that reruns agree."""
    rows = training_sample(docs, labels, per_class).toPandas().sort_values(["doc_id", "quality", "text"])
    return train(rows["text"].tolist(), rows["quality"].tolist())


def _values(words: list[str], parts: np.ndarray) -> np.ndarray:
    """What each word adds to the log-odds: the average over its rows."""
    rows, ends = _buckets_of(words)
    size = np.diff(ends, prepend=0)
    return np.bincount(np.repeat(np.arange(len(words)), size), weights=parts[rows], minlength=len(words)) / size


def score(model: Model):
    """A column function: chance from 0 to 1 that a text is of class 1; null and empty texts have the bias alone."""
    parts, bias = model.parts, model.bias

    @F.arrow_udf(T.DoubleType())
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches, size=SLICE_BYTES):
            words, codes, starts = split_words(texts)
            real = np.array([bool(w) for w in words], bool)
            value = np.concatenate([np.empty(0), *(_values(words[at:at + WORDS_AT_ONCE], parts) for at in range(0, len(words), WORDS_AT_ONCE))]) * real
            text = np.repeat(np.arange(len(texts)), np.diff(starts))
            again = _repeats(codes, starts, real)
            n = np.bincount(text, weights=real[codes], minlength=len(texts)) + again
            total = np.bincount(text, weights=value[codes], minlength=len(texts)) + again * parts[SAME]
            yield pa.array(1 / (1 + np.exp(-np.clip(bias + total / np.maximum(1, n), -500, 500))))

    return scores


def scored(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``.

    Labels that are null or other than 0 and 1 are left out, and so are those
    of null ids and of ids that ``docs`` has not; equal labels of a document
    count once.  Only texts are scored.  Repeated rows are scored each; an empty table stays empty.
    """
    model = fit(docs, labels, per_class)
    out = docs.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("score", score(model)(whole_text()))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that the classifier does not reject, with the columns of ``docs``.

    Null texts are empty, and empty ones have the score of the bias.  Repeated
    rows are judged each, a score equal to the threshold is accepted, and an
    empty table stays empty.
    """
    model = fit(docs, labels, **options)
    return docs.withColumn("__score", score(model)(whole_text())).filter(F.col("__score") >= threshold).select(*docs.columns)
