"""Packing documents into token sequences by a grouping genetic algorithm.

Texts become token ids, cut into pieces of at most one sequence; only counts
and checksums leave the tokenizing task.  Full pieces are sequences.  All other
pieces are dealt by hash into groups of about ``GROUP_ITEMS``, which are packed
apart from each other; a group wastes less than one sequence.

A solution is a list of bins.  Crossover injects whole, well-filled bins of one
parent into another, takes out the bins that hold the same pieces, and puts the
displaced ones in by best fit.  Every group evolves on several islands, rows of
a DataFrame that different tasks work on; between epochs the best solution of an
island moves on to the next island of its group.
"""

from __future__ import annotations

import os
import random
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelmill.llm.common import coded_words, picked, slices, whole_text
from labelmill.operators.scale import cut_lineage

CAPACITY = 4096
END_ID = 1
GROUP_ITEMS = 2000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 12
POPULATION = 5
ROWS_PER_TASK = 4

#: Words whose ids a Python worker remembers for its next tasks; longer words are looked up each time.
CACHE_WORDS = 150_000
CACHE_CHARS = 32

#: Words that the tokenizer reads in one text.
AT_ONCE = 500

#: A word that tells the ids of other words apart: one token, which no word without this character has.
BETWEEN = "\x1f"

#: How the tokenizer marks tokens that end a run of letters.
WORD_END = "</w>"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ISLANDS = "group long, island int, items array<long>, sizes array<int>, population array<array<int>>, bins int, waste double"
_PLACED = "group long, item long, bin int, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Marks that, behind letters, are a run of their own; an apostrophe may start a token with the letters after it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: Letters whose small form Arrow and the tokenizer must agree on: one precomposed Latin letter for another.
LATIN = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c != "\u0130")
_LATIN_WORD = f"^[{LATIN}]+[{re.escape(MARKS)}]*$"
_SMALL_RUN = f"^[{''.join(c for c in LATIN if c == c.lower())}]+$"


def _letters() -> str:
    """Letters that the tokenizer's normal form leaves letters, without a combining mark that would join the marks behind."""
    return "".join(c for c in map(chr, range(0x10000)) if c.isalpha() and unicodedata.normalize("NFC", c).lower().isalpha())


def _letter_word(letters: str) -> str:
    """A pattern for words of these letters, given as ranges, and marks behind them."""
    codes = np.array([ord(c) for c in letters])
    ranges = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return "^[" + "".join(f"\\x{{{r[0]:x}}}-\\x{{{r[-1]:x}}}" for r in ranges) + f"]+[{re.escape(MARKS)}]*$"


def process_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, which runs task after task."""
    return vars(sys.modules.setdefault("labelmill_cache", types.ModuleType("labelmill_cache"))).setdefault(name, {})


class WordTokens:
    """Token ids of whole texts by a tokenizer whose tokens never cross ASCII white space.

    Such a text is a row of words, so its ids are those of its words.  The
    different words of many texts are looked up together; a bounded number is
    kept for the next texts.  Words and ids are arrays, with no step in Python
    for each word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # Read once by a Python worker, not by each of its tasks.
        self.kept = process_cache(f"words of {path}")
        if not self.kept:
            tokenizer = Tokenizer.from_file(path)
            vocabulary = tokenizer.get_vocab()
            ends = np.zeros(1 + max(vocabulary.values()), bool)
            ends[[k for token, k in vocabulary.items() if token.endswith(WORD_END)]] = True
            letters = _letters()
            self.kept.update(tokenizer=tokenizer, ends=ends, letters=letters, letter_word=_letter_word(letters))
            self.kept.update(words=pa.array([""], pa.string()), ids=np.zeros(0, "<u4"), sizes=np.zeros(1, np.int64))
        self.tokenizer, self.ends = self.kept["tokenizer"], self.kept["ends"]
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None

    def look_up(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Words in another order, their ids in a row, and the number of ids of each; many words are read in one text.

        Small Latin letters alone are one run, which ends with a token for the
        end of a word.  Other words have a word between them that none of them
        has.  Words that may hold special tokens are looked up one by one, as
        the tokenizer reads them.
        """
        runs = pc.match_substring_regex(words, _SMALL_RUN)
        letters, rest = words.filter(runs), words.filter(pc.invert(runs))
        odd = pc.or_(pc.match_substring(rest, "<|"), pc.match_substring(rest, BETWEEN))
        alone, others = (rest, rest.slice(0, 0)) if self.between is None else (rest.filter(odd), rest.filter(pc.invert(odd)))
        found = [self._one_by_one(alone)]
        for part, ids in self._read(letters, " "):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            # Otherwise this tokenizer has no token of its own for the end of a word.
            whole = len(cuts) == len(part) and cuts[-1] == len(ids)
            found.append((ids, np.diff(cuts, prepend=0)) if whole else self._one_by_one(part))
        for part, ids in self._read(others, f" {BETWEEN} "):
            cuts = np.flatnonzero(ids == self.between)
            whole = len(cuts) == len(part) - 1
            found.append((np.delete(ids, cuts), np.diff(cuts, prepend=-1, append=len(ids)) - 1) if whole else self._one_by_one(part))
        ids, sizes = map(np.concatenate, zip(*found))
        return pa.concat_arrays([alone, letters, others]), ids, sizes

    def _read(self, words: pa.Array, between: str) -> Iterator[tuple[pa.Array, np.ndarray]]:
        starts = [*range(0, len(words), AT_ONCE), len(words)]
        for at, text in zip(starts, pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), between).to_pylist()):
            (encoded,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            yield words.slice(at, AT_ONCE), np.array(encoded.ids, dtype="<u4")

    def _one_by_one(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch(words.to_pylist(), add_special_tokens=False)]
        return np.array([i for part in ids for i in part], dtype="<u4"), np.array([len(part) for part in ids], dtype=np.int64)

    def _cores(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words whose ids are known more often, and the marks to add to them.

        Letters and the marks after them are tokens of their own, and case does
        not matter.  Only Latin letters are made small.
        """
        lettered = pc.match_substring_regex(words, self.kept["letter_word"])
        cores = pc.if_else(lettered, pc.utf8_rtrim(words, characters=MARKS), words)
        marks = pc.if_else(lettered, pc.utf8_ltrim(words, characters=self.kept["letters"]), "")
        return pc.if_else(pc.match_substring_regex(words, _LATIN_WORD), pc.utf8_lower(cores), cores), marks

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words in a row, and where those of each end."""
        kept = self.kept
        cores, marks = self._cores(words.cast(pa.string()))
        coded = pa.concat_arrays([cores, marks]).dictionary_encode()
        new = coded.dictionary.filter(pc.invert(pc.is_in(coded.dictionary, value_set=kept["words"])))
        looked_up, ids, sizes = self.look_up(new)
        table = pa.concat_arrays([kept["words"], looked_up])
        ids, ends = np.concatenate([kept["ids"], ids]), np.cumsum(np.concatenate([kept["sizes"], sizes]))
        # Words met early are the frequent ones and stay.
        stay = new.filter(pc.less_equal(pc.utf8_length(new), CACHE_CHARS)).slice(0, max(0, CACHE_WORDS - len(kept["words"])))
        if len(stay):
            at, to = picked(ends, pc.index_in(stay, value_set=table).to_numpy())
            kept.update(
                words=pa.concat_arrays([kept["words"], stay]), ids=np.concatenate([kept["ids"], ids[at]]), sizes=np.concatenate([kept["sizes"], np.diff(to)]))
        # A word's ids are those of its core, then those of its marks.
        which = pc.index_in(coded.dictionary, value_set=table).to_numpy().astype(np.int64)[coded.indices.to_numpy()]
        at, to = picked(ends, which.reshape(2, -1).T.ravel())
        return ids[at], to[2::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where those of each start (one more for the end)."""
        words, codes, starts = coded_words(texts)
        ids, ends = self.ids_of(words)
        at, to = picked(ends, codes)
        return ids[at], to[starts]


def _tokenized(path: str, capacity: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        for batch in slices(batches):
            ids, starts = tokens.encode(batch.column(1))
            out = []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                n = b - a + 1
                for k, at in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - at)
                    last = at + length == n
                    crc = zlib.crc32(ids[a + at:a + at + length - last].tobytes())
                    out.append((doc_id, k, at, length, zlib.crc32(end, crc) if last else crc))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return pieces


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: every document's ids and ``end_id``, cut at ``capacity``.

    A null or empty text has the end id alone.  Rows are documents of their
    own, also where ids repeat.  The tokenizer file is read by the tasks.
    """
    path = tokenizer or default_tokenizer()
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_tokenized(path, capacity, end_id), _PIECES)


class Packer:
    """The genetic operators for one group of sizes, all below the capacity."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity = sizes, capacity
        self.least = -(-sum(sizes) // capacity)
        self.random = random.Random(seed)

    def best_fit(self, bins: list[list[int]], room: list[int], items: list[int]) -> None:
        """Put items one by one where they leave least room.  Bins of each room
        are listed, and a bit per room tells which lists have bins."""
        lists: dict[int, list[int]] = {}
        bits = 0
        for b, r in enumerate(room):
            lists.setdefault(r, []).append(b)
            bits |= 1 << r
        for i in items:
            size = self.sizes[i]
            fitting = bits >> size
            if fitting:
                r = size + (fitting & -fitting).bit_length() - 1
                b = lists[r].pop()
                if not lists[r]:
                    bits ^= 1 << r
                bins[b].append(i)
            else:
                r, b = self.capacity, len(bins)
                bins.append([i])
                room.append(0)
            room[b] = r - size
            if not lists.setdefault(room[b], []):
                bits |= 1 << room[b]
            lists[room[b]].append(b)

    def fresh(self, noise: float) -> list[list[int]]:
        """Best fit by falling size, or by sizes with some noise."""
        order = sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i] * (1 + noise * self.random.random()), i))
        bins: list[list[int]] = []
        self.best_fit(bins, [], order)
        return bins

    def fill(self, b: list[int]) -> int:
        return sum(map(self.sizes.__getitem__, b))

    def cost(self, bins: list[list[int]]) -> tuple[int, float]:
        """Number of bins, then unevenness: a solution that leaves its room in few bins comes first."""
        return len(bins), -sum((self.fill(b) / self.capacity) ** 2 for b in bins)

    def crossover(self, base: list[list[int]], donor: list[list[int]]) -> list[list[int]]:
        by_fill = sorted(donor, key=self.fill, reverse=True)
        top = by_fill[: max(1, len(by_fill) // 2)]
        injected = self.random.sample(top, max(1, len(top) // 2))
        taken = {i for b in injected for i in b}
        kept = [list(b) for b in base if taken.isdisjoint(b)]
        # The emptiest kept bins are opened as well, or there is nothing to improve on.
        kept.sort(key=self.fill, reverse=True)
        opened = kept[len(kept) - len(kept) // 10:]
        kept = kept[: len(kept) - len(opened)]
        child = [list(b) for b in injected] + kept
        here = taken.union(*kept) if kept else taken
        displaced = sorted((i for i in range(len(self.sizes)) if i not in here), key=lambda i: -self.sizes[i])
        self.best_fit(child, [self.capacity - self.fill(b) for b in child], displaced)
        return child

    def evolve(self, population: list[list[list[int]]], generations: int, most: int) -> list[list[list[int]]]:
        while len(population) < most:
            population.append(self.fresh(0.0 if not population else 0.3))
        # Costs are kept beside the solutions, so that each is worked out once.
        scored = sorted(((self.cost(bins), bins) for bins in population), key=itemgetter(0))
        for _ in range(generations):
            if len(scored[0][1]) <= self.least:
                break
            (_, base), (_, donor) = self.random.sample(scored, 2) if len(scored) > 1 else (scored[0], scored[0])
            child = self.crossover(base, donor)
            scored = sorted([*scored, (self.cost(child), child)], key=itemgetter(0))[:most]
        return [bins for _, bins in scored]


def _bins(assigned: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(max(assigned, default=-1) + 1)]
    for i, b in enumerate(assigned):
        out[b].append(i)
    return out


def _assigned(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for b, items in enumerate(bins):
        for i in items:
            out[i] = b
    return out


def _evolved(capacity: int, generations: int, most: int, epoch: int):
    def evolve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                sizes = np.asarray(r.sizes).tolist()
                packer = Packer(sizes, capacity, seed=hash((int(r.group), int(r.island), epoch)))
                population = packer.evolve([_bins(np.asarray(p).tolist()) for p in (r.population if r.population is not None else [])], generations, most)
                cost = packer.cost(population[0])
                rows.append((r.group, r.island, r.items, r.sizes, [_assigned(p, len(sizes)) for p in population], cost[0], cost[1]))
            yield pd.DataFrame(rows, columns=["group", "island", "items", "sizes", "population", "bins", "waste"])

    return evolve


def _offsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for r in frame.itertuples():
            filled: dict[int, int] = {}
            offsets = []
            for b, size in zip(r.best, r.sizes):
                offsets.append(filled.get(b, 0))
                filled[b] = offsets[-1] + int(size)
            yield pd.DataFrame({
                "group": r.group, "item": r.items, "bin": np.asarray(r.best, dtype=np.int32), "offset": np.asarray(offsets, dtype=np.int64)})


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, islands: int = ISLANDS,
    epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Offsets of a sequence are gapless from 0.  Sequences of full pieces have
    ids below 0.  Repeated rows are packed each; an empty table stays empty.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    frozen = cut_lineage(pieces.select(F.struct(*names).alias("piece"), F.col("length"), F.monotonically_increasing_id().alias("item")))
    small = frozen.filter(F.col("length") < capacity)
    n_groups = max(1, -(-small.count() // group_items))
    groups = (
        small.select(F.pmod(F.xxhash64("item"), F.lit(n_groups)).alias("group"), F.struct("item", F.col("length").cast("int").alias("size")).alias("one"))
        .groupBy("group").agg(F.sort_array(F.collect_list("one")).alias("all"))
    )
    rows = groups.select(
        "group", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("all.item").alias("items"), F.col("all.size").alias("sizes"),
        F.lit(None).cast("array<array<int>>").alias("population"),
    )
    # The rows are small and their work is not, so their number of tasks is set here: as many as shuffles have,
    # and more where each gets several rows, as starting a task costs about as much as a row.
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(n_groups * islands, 8 * shuffles, max(shuffles, n_groups * islands // ROWS_PER_TASK))
    ring = Window.partitionBy("group").orderBy("island")
    last = Window.partitionBy("group").orderBy("island").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for epoch in range(epochs):
        rows = rows.repartition(tasks, "group", "island").mapInPandas(_evolved(capacity, generations, population, epoch), _ISLANDS)
        rows = cut_lineage(rows)
        if epoch + 1 < epochs and islands > 1:
            elite = F.col("population")[0]
            guest = F.coalesce(F.lag(elite).over(ring), F.last(elite).over(last))
            rows = rows.withColumn("population", F.concat(F.array(guest), "population")).drop("bins", "waste")
    best = rows.groupBy("group").agg(F.min_by(F.struct("items", "sizes", F.col("population")[0].alias("best")), F.struct("bins", "waste", "island")).alias("r"))
    placed = best.select("group", "r.*").mapInPandas(_offsets, _PLACED)
    packed = small.join(placed, "item").withColumn("sequence_id", F.shiftleft("group", 32) + F.col("bin"))
    whole = frozen.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    out = [*[F.col(f"piece.`{c}`") for c in names], "sequence_id", "offset"]
    return packed.select(*out).unionByName(whole.select(*out))

