"""The neighbour search of one block and one piece: its rows equal brute force, and it looks at few pairs closely."""

import os
import subprocess
import sys

import numpy as np
import pytest

from lendlens.operators import vector_index
from lendlens.operators.vector_index import Probes, nearest_rows, probes_for_recall


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(q, q_rank, wanted, base, base_rank, cell, k, exclude_self):
    """(query, base row, distance), summed from left to right; what is no number last, then by id."""
    numbers = np.unique(cell, return_inverse=True)[1]
    total = np.zeros((len(q), len(base)))
    with np.errstate(invalid="ignore"):
        for j in range(q.shape[1]):
            total = total + q[:, j][:, None] * base[:, j][None, :] if j else q[:, 0][:, None] * base[:, 0][None, :]
    out = []
    for i in range(len(q)):
        use = wanted[i][numbers] & ((base_rank != q_rank[i]) | (not exclude_self))
        rows = np.flatnonzero(use)
        d = 1.0 - total[i, rows]
        order = np.lexsort((base_rank[rows], d))[:k]
        out += [(i, int(base_rank[rows[o]]), "none" if np.isnan(d[o]) else float(d[o])) for o in order]
    return sorted(out, key=str)


def found(q, q_rank, wanted, base, base_rank, cell, k, exclude_self, **more):
    a, b, d = nearest_rows(q, q_rank, wanted, np.zeros(len(q), int), base, base_rank, cell, k, exclude_self, **more)
    return sorted(((int(i), int(base_rank[j]), "none" if np.isnan(x) else float(x)) for i, j, x in zip(a, b, d, strict=True)), key=str)


@pytest.mark.parametrize("every", [True, False])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_odd_rows_equal_brute_force(monkeypatch, every, exclude_self):
    """Copies, copies but for the last bits (nearer than single precision tells), vectors of no length, of tiny
    numbers and of no numbers, ids that come twice, more rows than a product takes at once."""
    monkeypatch.setattr(vector_index, "TILE_ROWS", 40)
    monkeypatch.setattr(vector_index, "TILE_COLUMNS", 64)
    rnd = np.random.default_rng(4)
    base = unit(rnd.normal(size=(400, 7)))
    base[50:90] = base[3]
    base[90:250] = base[4] + 1e-8 * rnd.normal(size=(160, 7))
    base[250:255] = 0.0
    base[255:258] = 1e-200 * base[255:258]
    base[258:290, 2] = np.nan
    rank = rnd.permutation(400)
    rank[300:304] = rank[10]
    cell = rnd.choice([2, 5, 6, 9], size=400)
    cell[90:250] = 5
    wanted = np.ones((400, 4), bool) if every else rnd.random((400, 4)) < 0.5
    wanted[258:290] = wanted[258]  # as those of no numbers are sent
    args = (base, rank, wanted, base, rank, cell, 6, exclude_self)
    assert found(*args) == brute(*args)


def test_fewer_rows_than_asked_for_are_filled_with_those_of_no_numbers():
    rnd = np.random.default_rng(2)
    base = unit(rnd.normal(size=(9, 4)))
    base[4:] = np.nan
    args = (base, np.arange(9), np.ones((9, 1), bool), base, np.arange(9), np.zeros(9, int), 5, True)
    assert found(*args) == brute(*args)


TIMED = """
import time
import numpy as np
from lendlens.operators.vector_index import Probes, nearest_rows, probes_for_recall
x = np.random.default_rng(1).normal(size=(6000, 64))
x /= np.linalg.norm(x, axis=1, keepdims=True)
n = len(x)
args = (x, np.arange(n), np.ones((n, 20), bool), np.zeros(n, int), x, np.arange(n), np.arange(n) % 20, 10, True)
def product():
    for at in range(0, n, 256):
        x[at : at + 256] @ x.T
def seconds(f, *a):
    began = time.process_time()
    f(*a)
    return time.process_time() - began
print(min(seconds(nearest_rows, *args) for _ in range(3)) / min(seconds(product) for _ in range(3)))
"""


def test_a_search_takes_about_the_time_of_its_matrix_product():
    """All rows with all, on one core as in a task (F1): ranking the products must not take many times what making
    them does."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1", "PYTHONPATH": root}
    told = subprocess.run([sys.executable, "-c", TIMED], env=env, capture_output=True, text=True, check=True, timeout=120)
    print(f"{float(told.stdout):.1f} times the product")
    assert float(told.stdout) < 3.5


def test_probed_cells_are_the_nearest_of_equal_ones_the_first():
    """As a whole stable sort tells (F2), for more rows than are looked at together and for what is no number."""
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-1, 2, size=(40, 3)).astype(float)
    q = rnd.integers(-1, 2, size=(2500, 3)).astype(float)
    q[7] = np.nan
    far = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] - 2.0 * q @ centres.T + (centres * centres).sum(axis=1)[None, :], 0.0))
    for nprobe in (1, 6, 39):
        want = np.zeros(far.shape, bool)
        np.put_along_axis(want, np.argsort(far, axis=1, kind="stable")[:, :nprobe], True, axis=1)
        only = np.array([0, 3, 4, 39])
        got = Probes(centres.tolist(), nprobe).cells(q, np.zeros(len(q)), only)[0]
        assert (got == want[:, only]).all()


def test_recall_sample_counts_true_neighbours(spark):
    """The probes of a recall goal on rows of which half have their neighbours in the other cell; rows of one's own
    id, which comes twice, aren't neighbours (F2: the sample's search sorts no more rows than it keeps)."""
    angle = np.concatenate([np.linspace(-0.4, 0.4, 40), np.linspace(2.0, 2.4, 20)])
    v = np.column_stack([np.cos(angle), np.sin(angle)])
    ids = list(range(58)) + [0, 1]
    cells = spark.createDataFrame([(i, x.tolist(), int(x[1] > 0)) for i, x in zip(ids, v, strict=True)], "_bid long, _unit array<double>, _cell int")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "_qid long, _qunit array<double>")
    centres = [[0.98, -0.2], [0.98, 0.2]]
    assert probes_for_recall(asked, cells, centres, 1.0, 3, True) == 2
    assert probes_for_recall(asked, cells, centres, 0.9, 3, True) == 1


def test_rows_beyond_a_known_bound_are_passed_over():
    """The second round of the exact search knows the first's k-th distance (F4): rows beyond it are not ranked
    again, rows at it are."""
    rnd = np.random.default_rng(6)
    base, n = unit(rnd.normal(size=(500, 8))), 500
    args = (base, np.arange(n), np.ones((n, 1), bool), base, np.arange(n), np.zeros(n, int), 6, True)
    every = brute(*args)
    bound = np.array([np.sqrt(2.0 * sorted(d for i, _, d in every if i == q)[2]) for q in range(n)])
    got = found(*args, bound=bound)
    assert [r for r in every if r[2] <= bound[r[0]] ** 2 / 2.0 + 1e-12] == [r for r in got if r[2] <= bound[r[0]] ** 2 / 2.0 + 1e-12]
    assert len(got) < 1.01 * 3 * n
