import hashlib
import random
import zlib

import numpy as np
import pytest

from labelmill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path int, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        path = (*turns.get(base, [])[:h], *own[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    def below(p):
        todo = [p]
        while todo:
            x = todo.pop()
            yield x
            todo += children.get(x, [])

    for p, m in members.items():
        leaves = sum(x not in children for x in below(p))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below(p) if x)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves, saved, digest


def rows_of(seed, convs, texts, most):
    rng = random.Random(seed)
    # Turn numbers do not repeat within a conversation, so that their order is known.
    return [(c, t * 3 if t else None, rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "é", *map(str, range(texts))]))
            for c in convs for t in rng.sample(range(40), rng.randrange(1, most))]


@pytest.mark.parametrize("range_turns", [3, 40, 10**6])
@pytest.mark.parametrize("texts", [1, 3])
def test_nodes_against_sets_of_prefixes(spark, range_turns, texts):
    rows = rows_of(texts, [*range(-12, 90), 1000, 1003, 2**40 + 1], texts, 7)
    rows += [(c, t, "user", "copy") for c in range(200, 260) for t in range(4)]
    rows += [(300, t, "user", f"long {t}") for t in range(300)] + [(301, t, "user", f"long {t}") for t in range(290)]
    rows += [(None, 0, "user", "nobody"), (400, 0, "user", "same"), (400, 0, "user", "same")]
    turns = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(4)
    got = trie.prefix_trie(turns, range_turns)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected(rows), key=str)


def test_empty_tables_and_conversations_without_turns(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # A conversation that is shorter than what it takes from one that is absent has no turns.
    lone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "gone"), (lone, 1, "user", "gone")]
    got = trie.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()
    assert [tuple(r) for r in got] == list(expected(rows)) and len(got) == 1 and got[0].n_leaves == 1


def test_double_array_holds_its_paths_and_no_others():
    rng = np.random.default_rng(5)
    turns = rng.integers(0, 256, (50, trie.KEY), dtype=np.uint8)
    lengths = rng.integers(0, 9, 300)
    picked = [rng.integers(0, 50, n) for n in lengths]
    keys = turns[np.concatenate(picked).astype(int)]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    array = trie.DoubleArray(keys, starts, lengths)
    ends = {tuple(p.tolist()): int(array.walk(int(s), int(n))[-1]) for p, s, n in zip(picked, starts, lengths)}
    prefixes = {k[:d] for k in ends for d in range(len(k) + 1)}
    used = np.concatenate(array.order)
    assert len(used) == len(set(used.tolist())) == len(prefixes) and len(set(ends.values())) == len(ends)
    assert (array.check[used[1:]] >= 0).all() and array.end < 4 * len(used) + 50
    array.turn[starts[lengths > 0][0]] += 1000
    with pytest.raises(LookupError):
        array.walk(int(starts[lengths > 0][0]), 1)
