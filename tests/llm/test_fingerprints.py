import hashlib
import random
import re

import pytest

from labelmill.llm import fingerprints


def shingles(text):
    words = re.split(r"[\x20\x09-\x0D]+", text.strip(" \t\n\x0b\x0c\r"))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def true_likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edit(text, after):
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def ordered(rows):
    """Descending ids, null last."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


def test_edited_texts_and_likeness(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)] + ["é", "日本", "😀"]
    rows = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 900))]
        rows.append((i * 7, " ".join(base)))
        changed = list(base)
        for _ in range(len(base) // 60):
            changed[rng.randrange(len(base))] = "changed"
        rows.append((i * 7 + 1, " ".join(changed)))
    got = {r.doc_id: r for r in fingerprints.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    order, errors = ordered(rows), []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        r, edited = got[i], edit(t, after)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert re.fullmatch("[0-9a-f]{256}", r.fingerprint)
        for estimate, other in ((r.near_edited, edited), (r.near_next, after)):
            errors.append(estimate - true_likeness(t, other))
    assert abs(sum(errors) / len(errors)) < 0.01, "chance agreement is taken out"
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05 and max(map(abs, errors)) < 0.2


def python_print(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.fp for r in fingerprints.with_fingerprint(df, "text", "fp").orderBy("i").collect()]


def test_empty_bins_take_the_same_filled_bins(spark):
    """Texts of few shingles: their likeness holds although nearly all bins are empty."""
    rng = random.Random(8)
    pairs = []
    for _ in range(150):
        words = [f"v{rng.randrange(10**6)}" for _ in range(16)]
        pairs += [" ".join(words[:14]), " ".join(words[2:])]
    prints = python_print(spark, pairs)
    want = true_likeness(pairs[0], pairs[1])
    got = []
    for a, b in zip(prints[::2], prints[1::2]):
        same = sum(x == y for x, y in zip(a, b)) / 256
        got.append((same - 1 / 16) / (15 / 16))
    assert abs(sum(got) / len(got) - want) < 0.03


def test_equal_and_short_texts(spark):
    texts = ["", None, " \n", "one", "one two", "one  two\n", "two one", "a b c d e", "a b c d e f", "x " * 3000, "x " * 5]
    fp = python_print(spark, texts)
    assert fp[0] == fp[1] == fp[2] and fp[4] == fp[5] and fp[9] == fp[10]
    assert len({fp[0], fp[3], fp[4], fp[6], fp[7], fp[8], fp[9]}) == 7


def test_nasty_documents(nasty, nasty_texts, nothing):
    got = fingerprints.edited_pairs(nasty).collect()
    assert len(got) == len(nasty_texts)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.n_chars, r.edited_sha256))
    order = ordered([r for r in nasty_texts if r[0] not in (6, None)])
    place = {i: k for k, (i, _) in enumerate(order)}
    for i in (20, 21, 25, 8, 9, 10, 4):
        t, after = order[place[i]][1], order[place[i] + 1][1]
        assert by_id[i] == {(len(t), hashlib.sha256(edit(t, after).encode()).hexdigest())}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.edited_pairs(nothing).count() == 0


def test_one_document_is_its_own_next(spark):
    r = fingerprints.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == pytest.approx(1.0)


def test_no_python_and_one_shuffle_of_texts(spark, nasty):
    df = fingerprints.edited_pairs(nasty)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
