import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from labelmill.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def brute(tokenizer, rows, capacity=4096):
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=str)


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def encoded(words, texts):
    ids, starts = words.encode(pa.array(texts))
    return [part.tolist() for part in np.split(ids, starts[1:-1])]


ODD = ["bad$$$ LOUD!! Une.*** x<| a<|b c'... d.'s e-- (f) g_ h^~ [i] ij\"'' k's. l's!", "a\x1fb \x1f c", "\x1f", "\x1f\x1f", " ", "",
       "a\x1cb", "Á ́x", "ΑΣ Σ ΣΑΣ", "x<|startoftext|y>", " a\xa0b", "don't I'LL 'S ' s", "İstanbul", "e ́\n\r\x0b\x0c\t", "12 3a4 !!?", "日本 語", "😀a😀",
       "Été, ÉTÉ. été. STRASSE, straße ŒUVRE. ÿ, Ÿ. ŉ. ſ, a., b.. C,, don't, DON'T. É, x̌, X̌."]


def test_ids_equal_those_of_the_tokenizer(tokenizer, nasty_texts):
    texts = ODD + [t[:5000] for _, t in nasty_texts] + [" ".join(ODD) * 3]
    for known in (packing.CACHE_WORDS, 3):
        words = packing.WordTokens(packing.default_tokenizer())
        packing.CACHE_WORDS, kept = known, packing.CACHE_WORDS
        got = encoded(words, texts * 2)
        packing.CACHE_WORDS = kept
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] * 2


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|>", "x<|startoftext|>y <|startoftext|> z", "a<|endoftext|>b<|endoftext|><|startoftext|>C.",
           "\t<|endoftext|>\n<|ENDOFTEXT|> <|endoftext| >", "<<|endoftext|>> é<|startoftext|>É, 'S<|endoftext|>'s"]


def test_special_tokens_in_texts_are_those_of_the_tokenizer(spark, tokenizer):
    words = packing.WordTokens(packing.default_tokenizer())
    plain = [tokenizer.encode(t, add_special_tokens=False).ids for t in SPECIAL]
    assert plain[0] == [320, 49407, 321]
    assert encoded(words, SPECIAL * 2) == plain * 2
    rows = list(enumerate(SPECIAL)) + [(99, "<|endoftext|> word " * 3000)]
    got = packing.token_pieces(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(tokenizer, rows)


def test_documents_are_packed_whole(nasty, nasty_texts, nothing, tokenizer):
    rows = packing.pack(packing.token_pieces(nasty)).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str) == brute(tokenizer, nasty_texts)
    check_places(rows, 4096)
    assert packing.pack(packing.token_pieces(nothing)).count() == 0


def test_groups_come_near_the_least_number(spark):
    rng = random.Random(5)
    rows = [(i, min(100, max(1, int(rng.lognormvariate(3.2, 0.8)))), "x") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, length long, bin string")
    got = packing.pack(df, capacity=100, group_items=400).collect()
    assert Counter((r.doc_id, r.length, r.bin) for r in got) == Counter(rows)
    least = -(-sum(n for _, n, _ in rows) // 100)
    assert least <= check_places(got, 100) <= least * 1.01 + 4


def test_crossover_keeps_every_piece_and_search_improves():
    rng = random.Random(6)
    worse = 0
    for seed in range(8):
        sizes = [rng.randrange(20, 60) for _ in range(120)]
        packer = packing.Packer(sizes, 100, seed)
        a, b = packer.fresh(0.0), packer.fresh(0.3)
        child = packer.crossover(a, b)
        assert sorted(i for bin_ in child for i in bin_) == list(range(120)) and max(map(packer.fill, child)) <= 100
        best = packer.evolve([], 150, 6)[0]
        assert len(best) <= len(a)
        worse += len(a) - len(best)
    assert worse > 0


def test_elites_move_to_the_next_island(spark):
    df = spark.createDataFrame([(i, 30 + i % 40) for i in range(100)], "doc_id long, length long")
    one = packing.pack(df, capacity=100, islands=1, epochs=1, generations=0, population=1)
    many = packing.pack(df, capacity=100, islands=3, epochs=3, generations=40, population=4)
    assert check_places(many.collect(), 100) <= check_places(one.collect(), 100)


def test_each_solution_is_costed_once(monkeypatch):
    costed = []
    monkeypatch.setattr(packing.Packer, "cost", lambda self, bins, cost=packing.Packer.cost: costed.append(1) or cost(self, bins))
    packer = packing.Packer([2000 + 7 * i for i in range(150)], 4096, 1)
    packer.least = 0
    assert len(packer.evolve([], 6, 4)) == 4 and len(costed) == 4 + 6


def test_latin_words_are_taken_apart_as_the_tokenizer_does(tokenizer):
    texts = [" ".join(f"{a}{c}{b}{mark}" for c in packing.LATIN) for a, b, mark in (("", "", ""), ("a", "", ","), ("É", "z", "!?'"), ("", "Ĳ", "\\]^-["))]
    texts += [c for c in packing.LATIN] + [f"İ{c} x{c}́. {c}ǅ, {c}'s {c}1!" for c in packing.LATIN]
    assert encoded(packing.WordTokens(packing.default_tokenizer()), texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_marks_stay_with_letters_that_lower_or_composed_end_in_a_combining_mark(tokenizer):
    texts = ["Σ\u0130<]^ \u0130, x\u0130.. a\u0130!b", "\u0958, \u0959. \u095c!! \u0915\u093c, \ufb2a, \ufb40.", "слово, СЛОВО. Ǆ, 가, ᄀ. 日本!"]
    assert encoded(packing.WordTokens(packing.default_tokenizer()), texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("first", ["a", "а"])
def test_words_take_no_step_of_their_own(first):
    import sys

    words = packing.WordTokens(packing.default_tokenizer())
    text = " ".join("".join(chr(ord(first) + k // 26 ** p % 26) for p in range(3)) + "," for k in range(5000))
    steps = []
    sys.setprofile(lambda frame, event, arg: steps.append(event) if event in ("call", "c_call") else None)
    try:
        words.encode(pa.array([text]))
    finally:
        sys.setprofile(None)
    assert len(steps) < 2500


def test_the_tokenizer_file_is_read_once_by_a_worker(monkeypatch, tmp_path):
    import shutil

    import tokenizers

    path = shutil.copy(packing.default_tokenizer(), tmp_path / "words.json")
    read, from_file = [], tokenizers.Tokenizer.from_file

    class Counted:
        @staticmethod
        def from_file(path):
            read.append(path)
            return from_file(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    first, again = (encoded(packing.WordTokens(str(path)), ["Some words, and more!"]) for _ in range(2))
    assert first == again and len(read) == 1
