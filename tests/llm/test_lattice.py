import math
from itertools import product

import numpy as np

from labelmill.llm import lattice


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    steps = np.concatenate([np.zeros((1, 8)), lattice.roots()])
    assert len(steps) == 241
    x = rng.normal(0, 2, (500, 8))
    points = lattice.decode(x)
    doubled = np.rint(2 * points)
    assert np.allclose(doubled, 2 * points) and ((doubled % 2).std(axis=1) == 0).all() and (np.rint(points.sum(axis=1)) % 2 == 0).all()
    nearby = ((x[:, None] - points[:, None] - steps) ** 2).sum(axis=2)
    assert (nearby.argmin(axis=1) == 0).all()


def brute(rows, cosine=0.98):
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    pairs = [(i, j) for i, j in product(ok, ok) if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in pairs:
        n[i] += 1
        n[j] += 1
        parent[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), r[0]) if x is not None), default=None)
    return sorted(str((r[0], n[i], least[find(i)], r[0] == least[find(i)])) for i, r in enumerate(rows))


def result(df):
    return sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in df.collect())


def planted(n, noise, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=64)
        rows.append((3 * i, v.tolist(), i % 4))
        w = rng.normal(size=64)
        w -= v * (w @ v) / (v @ v)
        w *= np.linalg.norm(v) / np.linalg.norm(w)
        rows.append((3 * i + 1, (v * math.cos(noise) + w * math.sin(noise)).tolist(), i % 4))
    return rows


def test_recall_at_the_hardest_cosine(spark):
    rows = planted(1500, math.acos(0.9801), 1)
    got = lattice.linked(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    links = sum(r.n_links for r in got)
    assert 0.97 * 3000 <= links <= 3000


def test_no_link_below_the_cosine(spark):
    rows = planted(200, math.acos(0.9799), 2)
    got = lattice.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sum(r.n_links for r in got) == 0 and all(r.kept for r in got)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=64).tolist()
    near = [x + 0.001 for x in v]
    rows = [(5, v, 1), (4, v, 1), (3, v, 2), (2, v, None), (9, near, 1), (7, [2 * x for x in v], 1), (7, [2 * x for x in v], 1), (1, None, 1), (11, [0.0] * 64, 1),
            (12, [None, *v[1:]], 1), (13, [math.nan, *v[1:]], 1), (14, [math.inf, *v[1:]], 1), (15, v[:8], 1), (16, v[:8], 1), (None, v, 1), (None, None, None),
            (17, [], 1), (18, [1e-300 * x for x in v[:8]], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, class string")
    rows[-1] = (18, v[:8], 1)
    assert result(lattice.linked(df)) == brute(rows)
    assert lattice.linked(df.filter("false")).count() == 0
