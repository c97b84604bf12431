"""Top partners in dense cells: the leaf search equals the cell join and brute force, and its work stays near linear."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.operators import dense_pairs as D
from lendlens.operators import pairs as P
from tests.test_pairs import SCHEMA, synthetic

LIMITS = D.Limits(0.05, 0.5, 2.0, 0.2, 0.1, 0.1, 0.05, 5)


def made(n, kind, seed=0):
    r = np.random.default_rng(seed)
    if kind == "spread":
        income, loan = 100 * np.exp(r.uniform(0, 0.4, n)), 200 * np.exp(r.uniform(0, 0.4, n))
        dti, rate = 0.3 + r.uniform(0, 0.2, n), r.uniform(0, 1, n)
    elif kind == "equal":
        income, loan, dti, rate = np.full(n, 100.0), np.full(n, 200.0), np.full(n, 0.3), np.full(n, 0.5)
    else:  # a hundred different rows, each many times
        income, loan = r.integers(100, 110, n) * 1.0, r.integers(200, 210, n) * 1.0
        dti, rate = np.full(n, 0.3), np.full(n, 0.5)
    vec = np.column_stack([income / 200, loan / 500, dti, (rate + 1) / 4])
    norm = np.sqrt(((vec[:, 0] ** 2 + vec[:, 1] ** 2) + vec[:, 2] ** 2) + vec[:, 3] ** 2)
    return D.Rows(r.permutation(n), income, loan, dti, norm, vec)


def brute(q, p, limits):
    out = set()
    for i in range(len(q)):
        dot = q.vec[i, 0] * p.vec[:, 0]
        for j in range(1, p.vec.shape[1]):
            dot = dot + q.vec[i, j] * p.vec[:, j]
        d = 1.0 - dot / (q.norm[i] * p.norm)
        income = np.abs(q.income[i] - p.income) / np.maximum(q.income[i], p.income)
        loan = np.abs(q.loan[i] - p.loan) / np.maximum(q.loan[i], p.loan)
        dti = np.abs(q.dti[i] - p.dti)
        later = (p.rank != q.rank[i]) if limits.both_directions else (p.rank > q.rank[i])
        keep = np.flatnonzero((d < limits.max_distance) & (income < 0.1) & (loan < 0.1) & (dti < 0.05) & later)
        best = np.lexsort([p.rank[keep], dti[keep], loan[keep], income[keep], d[keep]])[: limits.k]
        out |= {(i, int(j)) for j in keep[best]}
    return out


@pytest.mark.parametrize("kind", ["spread", "equal", "few"])
@pytest.mark.parametrize("both", [False, True])
def test_search_equals_brute_force(kind, both):
    limits = D.Limits(0.05, 0.5, 2.0, 0.2, 0.1, 0.1, 0.05, 5, both)
    rows = made(1200, kind)
    a, b, _ = D.Pool(rows, limits).search(rows)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == brute(rows, rows, limits)
    some, rest = rows.take(np.arange(300)), rows.take(np.arange(300, 1200))
    a, b, _ = D.Pool(rest, limits).search(some)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == brute(some, rest, limits)


@pytest.mark.parametrize("kind", ["spread", "equal", "few"])
def test_compared_pairs_grow_about_linearly(kind):
    """One cell of 12,500 and of 50,000 rows: all pairs would grow by 16; the pairs looked at grow by less than 5,
    and at 50,000 rows they are under a twentieth of all."""
    counts = []
    for n in (12_500, 50_000):
        pool = D.Pool(made(n, kind), LIMITS)
        base = made(n, kind)
        pool.search(base)
        counts.append(pool.compared)
    assert counts[1] < 5 * counts[0]
    assert counts[1] < 0.05 * 50_000 * 49_999 / 2


def cells(spark, n=700, ties=True):
    rows = []
    for i in range(n):
        inc, loan, dti = 100.0 + (i * 37 % 211) / 60, 200.0 + (i * 53 % 197) / 40, 0.3 + (i * 29 % 101) / 9000
        if ties and i % 3 == 0:
            inc, loan, dti = 101.0, 202.0, 0.301
        rows.append((f"D{i:04d}", "LH", "NY" if i % 50 else None, "White", "Male", "Hispanic", i % 2 == 0, inc, loan, dti,
                     [inc / 200, loan / 500, dti, 0.5 if i % 3 == 0 else (i % 17) / 17]))
    rows.append(("Y0001", "LH", "NY", "White", "Male", "Hispanic", True, 100.0, 200.0, 0.3, [0.0, 0.0, 0.0, 0.0]))
    return spark.createDataFrame(rows, SCHEMA)


COLS = ["base_app_id", "similar_app_id", "financial_similarity_distance", "demographic_difference_type"]


def same(a, b):
    a, b = a.select(*COLS), b.select(*COLS)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


@pytest.mark.parametrize("both", [False, True])
def test_dense_cells_equal_the_cell_join(spark, both, monkeypatch):
    monkeypatch.setattr(D, "PIECE_ROWS", 300)  # several pieces a cell
    for emb in (cells(spark), synthetic(spark, 400, 9)):
        want = P.similar_pairs(emb, heavy_cell=10**9, both_directions=both)
        assert same(P.similar_pairs(emb, heavy_cell=20, both_directions=both), want)
        assert same(P.similar_pairs(emb, heavy_cell=20, both_directions=both, vector_dim=4), want)


def test_one_cell_of_equal_rows(spark, monkeypatch):
    """Every row has the same values: the partners are the next five ids, over all pieces."""
    monkeypatch.setattr(D, "PIECE_ROWS", 1000)
    emb = spark.range(6000).select(
        F.format_string("E%05d", "id").alias("application_id"), F.lit("L").alias("lei"), F.lit("CA").alias("state_code"),
        F.lit("White").alias("race_category"), F.lit("Male").alias("gender_category"), F.lit("x").alias("ethnicity_category"),
        F.lit(True).alias("approved"), F.lit(100.0).alias("income"), F.lit(200.0).alias("loan_amount"), F.lit(0.3).alias("calculated_dti_ratio"),
        F.array(F.lit(0.5), F.lit(0.4), F.lit(0.3), F.lit(0.25)).alias("financial_embedding"),
    )
    got = P.similar_pairs(emb, heavy_cell=100).select("base_app_id", "similar_app_id").collect()
    want = {(f"E{i:05d}", f"E{j:05d}") for i in range(6000) for j in range(i + 1, min(i + 6, 6000))}
    assert len(got) == len(want) and {(r[0], r[1]) for r in got} == want
