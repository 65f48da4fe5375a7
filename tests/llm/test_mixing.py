import re
from collections import defaultdict

import pytest

from labelmill.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1, 2, 3), share=1.0, most=3):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def check(rows, docs, **options):
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = targets(sizes, **options)
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1


def test_targets_are_met_whole_and_again(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 91)), None if i % 11 == 0 else f"s{i * i % 5}") for i in range(300)]
    rows += [(900 + i, "tiny source", "z-tiny") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, keep=("doc_id", "source"), block_words=16, shard_slots=32)
    columns = ("doc.doc_id", "doc.source", "size", "source_size", "target", "taken")
    got = mixing.taken_words(mixed, *columns).collect()
    check(got, docs.collect())
    again = mixing.taken_words(mixing.mix(docs.repartition(3), keep=("doc_id", "source"), block_words=16, shard_slots=32), *columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    spans = mixed.spans.collect()
    assert len({r.shard for r in spans}) > 3
    used = defaultdict(int)
    for r in spans:
        used[r.row, r["pass"]] += r.n_words
    size = {r.row: r.size for r in mixed.rows.collect()}
    assert all(n <= size[row] for (row, _), n in used.items()), "a pass takes no word twice"


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(100))


def test_mixed_documents_hold_the_taken_words(spark, nasty):
    mixed = mixing.mixed_documents(nasty, block_words=8, shard_slots=16)
    assert mixed.columns == nasty.columns
    rows = mixed.collect()
    taken = defaultdict(int)
    for r in rows:
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    counts = mixing.taken_words(mixing.mix(nasty, block_words=8, shard_slots=16), "doc.doc_id", "taken").collect()
    want = defaultdict(int)
    for r in counts:
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(taken)


def test_nasty_and_empty(nasty, nothing):
    got = mixing.taken_words(mixing.mix(nasty, keep=("doc_id", "source")), "doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    assert len(got) == nasty.count()
    check(got, nasty.collect())
    assert mixing.taken_words(mixing.mix(nothing), "doc.doc_id", "taken").count() == 0
    assert mixing.mixed_documents(nothing).count() == 0


def test_blocks_are_merged_not_broadcast(spark, nasty):
    plan = mixing.mix(nasty).spans._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [source_no" in plan
