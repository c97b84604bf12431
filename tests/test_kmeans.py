"""K-means steps against a plain numpy version with Python integers."""

import hashlib
import math

import numpy as np

from lendlens.operators import kmeans as K


def plain(rows, k, steps=K.STEPS, standardize=True):
    rows = [(i, [math.floor(x * 2**20 + 0.5) for x in v]) for i, v in rows if v is not None]
    n, dim = len(rows), len(rows[0][1])
    z = []
    for j in range(dim):
        q = [v[j] for _, v in rows]
        s, s2 = sum(q), sum(x * x for x in q)
        m, sd = s / n, math.sqrt((n * s2 - s * s) / (n * (n - 1))) if n > 1 else 0.0
        z.append([(math.floor((x - m) / sd * 1024 + 0.5) if sd else 0) if standardize else math.floor(x / 1024 + 0.5) for x in q])
    x = [tuple(c[r] for c in z) for r in range(n)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    order = sorted(range(n), key=lambda r: (hashlib.md5(str(rows[r][0]).encode()).hexdigest(), str(rows[r][0])))[: K.CANDIDATES]
    centres = [x[order[0]]]
    while len(centres) < k:
        near = [min(far(x[r], c) for c in centres) for r in order]
        if max(near) == 0:
            break
        centres.append(x[order[near.index(max(near))]])
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(steps):
        own = [nearest(v) for v in x]
        for c in range(len(centres)):
            mine = [v for v, o in zip(x, own, strict=True) if o == c]
            if mine:
                centres[c] = tuple(math.floor(sum(col) / len(mine)) for col in zip(*mine, strict=True))
    return sorted((rows[r][0], nearest(x[r])) for r in range(n))


def table(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vid long, vec array<double>, _id int")


def run(df, k, **more):
    return sorted(tuple(r) for r in K.kmeans(df, "vid", "vec", k, **more).collect())


def made(n=140, dim=5, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i, [float(c) for c in centres[i % 6] + 0.4 * rng.normal(size=dim)]) for i in range(n)]


def test_equals_plain_steps(spark):
    rows = made() + [(900, None)] + [(901, made()[3][1])] * 3
    want = plain(rows, 7)
    assert run(table(spark, rows).repartition(5), 7) == want
    assert run(table(spark, rows).coalesce(1), 7) == want
    assert run(table(spark, rows), 4, steps=2, standardize=False) == plain(rows, 4, 2, False)


def test_clusters_are_found(spark):
    """Six well separated groups come out whole."""
    rng = np.random.default_rng(5)
    centres = np.eye(6) * 10
    rows = [(i, [float(c) for c in centres[i % 6] + 0.1 * rng.normal(size=6)]) for i in range(240)]
    got = dict(run(table(spark, rows), 6))
    assert all(len({got[i] for i in range(g, 240, 6)}) == 1 for g in range(6)) and len(set(got.values())) == 6


def test_degenerate_tables(spark):
    assert run(table(spark, []), 3) == [] and run(table(spark, [(1, None)]), 3) == []
    assert run(table(spark, [(1, [1.0, 2.0])]), 3) == [(1, 0)]
    assert run(table(spark, [(i, [1.0, 2.0]) for i in range(20)]), 3) == [(i, 0) for i in range(20)]
    flat = [(i, [float(i % 2), 7.0]) for i in range(10)]  # a coordinate that never changes
    assert run(table(spark, flat), 2) == plain(flat, 2)
