import hashlib
import random

import numpy as np

from labelmill.llm import suffix

N = suffix.LENGTH


def brute(rows):
    """Removed bytes of every row, window by window."""
    order = lambda i: float("inf") if i is None else i
    least = {}
    for i, t in rows:
        for p in range(len(t) - N + 1):
            w = t[p:p + N]
            least[w] = min(least.get(w, float("inf")), order(i))
    out = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - N + 1):
            if least[t[p:p + N]] < order(i):
                gone[p] += 1
                gone[p + N] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append(str((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def result(df):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def repetitive(seed, n_docs, letters):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randrange(30, 160))) for _ in range(12)]
    rows = []
    for i in range(n_docs):
        text = ""
        for _ in range(rng.randrange(6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            text += rng.choice([p, p[a:], p[:a], p[:a] + rng.choice(letters) + p[a + 1:], "".join(rng.choice(letters) for _ in range(rng.randrange(80)))])
        rows.append((i * 3 % n_docs, text))
    return rows


def test_random_passages(spark):
    for seed, letters in ((1, "ab"), (2, "abcdefghij klmnop"), (3, "é日a ")):
        rows = repetitive(seed, 90, letters)
        got = result(suffix.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")))
        assert got == brute([(i, t.encode()) for i, t in rows])


def test_hot_anchors_give_the_same(spark):
    rows = repetitive(5, 90, "abcd")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(suffix.deduplicated(df, hot_contexts=1)) == brute([(i, t.encode()) for i, t in rows])


def test_crowded_grams_give_the_same(spark):
    rows = repetitive(6, 120, "abcd")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute([(i, t.encode()) for i, t in rows])
    for limit in (0, 5, 60):
        assert result(suffix.deduplicated(df, cell_anchors=limit, cell_bytes=300)) == want
    assert result(suffix.deduplicated(df, cell_bytes=300)) == want


def test_a_cell_holds_a_bounded_number_of_anchors():
    rng = np.random.default_rng(8)
    cell, given, out = suffix.Cell(0, 1000), 0, 0
    for _ in range(40):
        n = 300
        codes = np.concatenate([np.where(rng.random((1, n)) < 0.4, 7, rng.integers(0, 5000, (1, n))), rng.integers(0, 9, (4, n))]).astype(np.uint32)
        doc = rng.integers(0, 10, n).astype(np.uint32)
        row = {"codes": codes.tobytes(), "doc": doc.tobytes(), "pos": np.arange(n).astype(np.uint64).tobytes(),
               "ids": np.arange(10).astype(np.int64).tobytes(), "keys": np.arange(10).astype(np.int64).tobytes()}
        for batch in cell.add(row):
            out += batch.num_rows
            assert set(batch.column("kind").to_pylist()) == {2} and set(batch.column("h").to_pylist()) <= set(cell.crowded.tolist())
        given += n
        assert cell.size <= 1000 and given == out + cell.size and sum(map(len, cell.ids)) <= cell.size
        assert not len(cell.crowded) or not np.isin(np.concatenate(cell.codes, axis=-1)[0], cell.crowded).any()
    assert 7 in cell.crowded


def test_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PART_BYTES", 400)
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, base), (2, "x" + base[1000:3000] + "yz" + base[100:149] + base[4000:]), (3, base[:49] + "q" + base[60:109]), (4, "a" * 3000), (5, "b" + "a" * 500)]
    assert result(suffix.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))) == brute([(i, t.encode()) for i, t in rows])


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    window = rng.integers(97, 100, N).astype(np.uint8)
    for before, after in ((0, 0), (13, 7), (200, 91)):
        data = np.concatenate([rng.integers(97, 123, before), window, rng.integers(97, 123, after)]).astype(np.uint8)
        x, codes = suffix.Anchors().find(data, np.array([0, len(data)]))
        inside = (x >= before) & (x + suffix.GRAM <= before + N)
        grams = set(codes[0, inside].tolist())
        if before == 0:
            first = grams
        assert first <= grams and len(first) == 1


def test_intervals_are_the_maximal_repeats():
    rng = random.Random(9)
    common = "".join(rng.choice("abcdef") for _ in range(60))
    contexts = [f"{a}{common[:n]}{b}".encode() for a, n, b in (("x", 60, "1"), ("y", 60, "2"), ("x", 55, "34567"), ("z", 52, "89012345"))]
    array = suffix.SuffixArray(contexts, np.array([1, 1, 1, 1]), np.arange(4))
    found = {(n, frozenset((int(array.context[i]), int(array.start[i])) for i in range(a, b + 1))) for n, a, b in array.maximal_repeats()}
    at_one = {(n, frozenset(c for c, s in places)) for n, places in found if all(s == 1 for _, s in places)}
    assert at_one == {(60, frozenset({0, 1})), (55, frozenset({0, 1, 2})), (52, frozenset({0, 1, 2, 3}))}
    from_left = {(n, frozenset(c for c, s in places)) for n, places in found if all(s == 0 for _, s in places)}
    assert from_left == {(56, frozenset({0, 2}))}


def test_nasty_documents(nasty, nasty_texts, nothing):
    assert result(suffix.deduplicated(nasty)) == brute([(i, t.encode()) for i, t in nasty_texts])
    assert suffix.deduplicated(nothing).count() == 0
