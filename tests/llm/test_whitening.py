"""QDWH divide and conquer and the whitened rows against numpy's own eigensolver."""

import math

import numpy as np
import pytest

from lendlens.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, n bigint, component int, x string"


def spectra(n, rng):
    yield rng.random(n)
    yield np.ones(n)
    yield np.zeros(n)
    yield 10.0 ** -np.arange(n).clip(max=14)
    yield np.repeat(rng.random(n), 3)[:n]  # triples of equal eigenvalues
    yield np.r_[np.zeros(n // 2), np.arange(n - n // 2)]
    yield np.r_[np.full(n - 1, 1.0), 1e6]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 130])
def test_spectral_equals_eigh(n):
    rng = np.random.default_rng(n)
    for values in spectra(n, rng):
        q = np.linalg.qr(rng.standard_normal((n, n)))[0]
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        e, v = whitening.spectral(a)
        size = max(np.abs(values).max(), 1e-300)
        assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * n * size
        assert np.abs(a @ v - v * e).max() <= 1e-14 * n * size
        assert np.abs(v.T @ v - np.eye(n)).max() <= 1e-14 * n
        assert (np.diff(e) <= 0).all()


def test_polar_factor():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((40, 40)) @ np.diag(10.0 ** -np.linspace(0, 12, 40))
    u = whitening.polar(a)
    assert np.abs(u.T @ u - np.eye(40)).max() < 1e-12
    h = u.T @ a
    assert np.abs(h - h.T).max() < 1e-12 and np.linalg.eigvalsh((h + h.T) / 2).min() > -1e-12


def brute(rows, components=32):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return [i for i, _ in kept], n, dev, y, cov, e, v


def check(got, rows, tolerance=1e-9):
    ids, n, dev, y, cov, e, v = brute(rows)
    k = len(e)
    table = {}
    for r in got:
        table.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    want = y @ v / np.sqrt(e)
    sign = np.zeros(k)
    for row, (i, d) in enumerate(zip(ids, dev, strict=True)):
        for c in range(k):
            r = table[(i, d)][c + 1][0]
            if not sign[c]:
                sign[c] = 1.0 if r["whitened"] * want[row, c] >= 0 else -1.0
            assert abs(r["whitened"] - sign[c] * want[row, c]) < tolerance * max(1.0, abs(want[row, c]))
            assert abs(r["explained"] - e[c] / np.trace(cov)) < 1e-9 * e[c] / np.trace(cov) + 1e-15
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whiten_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    mix = rng.standard_normal((7, 7))
    rows = [(i, [float(c) for c in rng.standard_normal(7) @ mix]) for i in range(300)]
    rows += [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 7), (903, [math.inf] + [0.0] * 6), (904, [-math.inf] * 7)]
    rows += [(None, rows[3][1]), rows[4]]  # a row without id, a repeated row
    df = spark.createDataFrame([(i, v, i, 1, "y") for i, v in rows], SCHEMA)
    check(whitening.whiten(df.repartition(3)).collect(), rows)
    # a vector of another length is dropped
    odd = spark.createDataFrame([(950, [1.0, 2.0], 1, 1, "y"), (951, [], 1, 1, "y")], SCHEMA)
    check(whitening.whiten(df.unionByName(odd)).collect(), rows)


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 1, "")], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [], 1, 1, "")], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, "")], SCHEMA)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 3.0, 2.0 * i], 1, 1, "") for i in range(9)], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in line) and line[0]["identity_error"] < 1e-12
    assert abs(sum(r["explained"] for r in line if r["vec_id"] == 0) - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + 8 * i), -float(i * 2**20)]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame([(i, v, i, 1, "") for i, v in rows], "vec_id bigint, embedding array<double>, n bigint, component int, x string")).collect()
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(r[j] for r in x) for j in range(2)]
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, sum((6 * x[i][j] - s[j]) ** 2 for j in range(2))) for i in range(6)}
    with pytest.raises(Exception, match="2\\^46"):
        whitening.whiten(spark.createDataFrame([(1, [1e300], 1, 1, "")], "vec_id bigint, embedding array<double>, n bigint, component int, x string")).collect()


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    check(whitening.op13_whitening(spark, d).collect(), rows, 1e-8)
