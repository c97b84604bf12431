"""Pairs of long vectors (F3): found where the rows of a cell lie, the same as brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from lendlens.operators import cell_pairs, pairs
from lendlens.operators.dense_pairs import Limits

COLUMNS = ("application_id string, lei string, state_code string, race_category string, gender_category string, ethnicity_category string, "
           "approved int, income double, loan_amount double, calculated_dti_ratio double, financial_embedding array<double>")


def applications(n=260, dim=12, seed=5):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = np.where(rnd.random(dim) < 0.4, rnd.choice([-1.0, 1.0, 2.0], size=dim), 0.0)
        v[0] = 3.0
        rows.append([f"A{rnd.integers(10**6)}-{i}", f"L{i % 3}", "CA", "Black" if i % 2 else "White", "Female", "Other", int(i % 5 > 1),
                     float(50 + 30 * rnd.random()), float(200 + 90 * rnd.random()), float(0.3 + 0.1 * rnd.random()), [float(x) for x in v]])
    rows[3][10], rows[6][10] = [0.0] * dim, None
    rows[9][10] = rows[12][10][:7]
    rows[15][10] = rows[18][10][:7]
    rows[21][10] = [math.nan] + rows[21][10][1:]
    rows[24][8], rows[27][9], rows[30][7], rows[33][7] = math.inf, math.nan, 0.0, None
    rows[36][0] = None
    rows[39][10] = [-0.0 if x == 0 else x for x in rows[39][10]]
    rows[42][7:] = rows[45][7:]
    return rows


def brute(rows, max_distance, k, both):
    out = {}
    for p in rows:
        found = []
        for q in rows:
            if p[0] is None or q[0] is None or p[1] != q[1] or not (p[0] != q[0] if both else p[0] < q[0]):
                continue
            if any(r[7] is None or not r[7] > 0 or r[10] is None or not math.isfinite(r[8]) or math.isnan(r[9]) for r in (p, q)) or len(p[10]) != len(q[10]):
                continue
            di, dl, dd = abs(p[7] - q[7]) / max(p[7], q[7]), abs(p[8] - q[8]) / max(p[8], q[8]), abs(p[9] - q[9])
            if not (di < 0.1 and dl < 0.1 and dd < 0.05):
                continue
            total, norms = 0.0, []
            for x, y in zip(p[10], q[10], strict=True):
                total += x * y
            for v in (p[10], q[10]):
                norm = 0.0
                for x in v:
                    norm += x * x
                norms.append(math.sqrt(norm))
            if all(n > 0 for n in norms) and (d := 1.0 - total / (norms[0] * norms[1])) < max_distance:
                found.append((d, di, dl, dd, q[0]))
        for d, *_, other in sorted(found)[:k]:
            out[p[0], other] = d
    return out


@pytest.mark.parametrize("both", [False, True])
def test_long_vectors_equal_brute_force(spark, both):
    rows = applications()
    df = spark.createDataFrame([tuple(r) for r in rows], COLUMNS)
    found = pairs.similar_pairs(df, max_distance=0.4, top_k=4, vector_dim=12, both_directions=both)
    got = {(r.base_app_id, r.similar_app_id): r.financial_similarity_distance for r in found.collect()}
    assert got == brute(rows, 0.4, 4, both) and len(got) > 300


def test_no_pair_is_joined_to_its_vectors(spark):
    """Before, every pair whose numbers agree was shuffled twice to meet its vectors, by its ids."""
    df = spark.createDataFrame([tuple(r) for r in applications()], COLUMNS)
    plan = pairs.similar_pairs(df, max_distance=0.4, vector_dim=12)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_long_cell_is_held_by_its_own_rows_and_their_best(monkeypatch):
    """A cell of many copies comes in batches: those that no own row keeps are let go, and the result is that of all
    rows at once, also in slices of few pairs."""
    rnd = np.random.default_rng(3)
    n = 900
    limits = Limits(0.5, 0.5, 2.0, 0.2, 0.1, 0.1, 0.05, 3)
    v = rnd.normal(size=(n, 10)) + 1.0
    v[:, 4:7] = 0.0
    rows = pa.table({
        "_own": [i < 25 for i in range(n)], "_id": rnd.permutation(n), "_income": 50 + 4 * rnd.random(n), "_loan": 200 + 40 * rnd.random(n),
        "_dti": 0.3 + 0.06 * rnd.random(n), "_dim": pa.array([10] * n, pa.int32()),
        "_bits": cell_pairs._bits(pa.array(v.tolist())), "_values": cell_pairs._values(pa.array(v.tolist())),
    })
    assert (cell_pairs.unpacked(rows)[0][:, :10] == v).all()
    a, b, _ = cell_pairs.search(rows, np.zeros(1, np.int64), limits)
    want = list(zip(a, b, strict=True))
    assert len(want) > 40
    monkeypatch.setattr(cell_pairs, "SLICE_PAIRS", 100)
    monkeypatch.setattr(cell_pairs, "SLICE_VECTORS", 7)
    a, b, _ = cell_pairs.search(rows, np.zeros(1, np.int64), limits)
    assert list(zip(a, b, strict=True)) == want
    monkeypatch.setattr(cell_pairs, "HELD_ROWS", 60)
    most, inner = [], cell_pairs.search
    monkeypatch.setattr(cell_pairs, "search", lambda rows, *more: most.append(rows.num_rows) or inner(rows, *more))
    keyed = rows.append_column("lei", pa.array(["L"] * n))
    out = list(cell_pairs.found_in(iter(keyed.to_batches(max_chunksize=50)), ["lei"], limits))
    ids = rows["_id"].to_pylist()
    assert [(x, y) for base, similar, _ in out for x, y in zip(base["_id"].to_pylist(), similar["_id"].to_pylist(), strict=True)] == [(ids[i], ids[j]) for i, j in want]
    assert max(most) <= 60 + 50 + 25 * 4
