"""Embedding whitening by QDWH spectral divide and conquer.

Rows: entries become integers (64 steps a unit, shifted), so that count and sums
are exact; a first pass gathers them, a second one the covariance of the centred
rows, as one d x d block of partial sums a task. The d x d problem is bounded by
the dimension, not by the data, and is solved by divide and conquer: the polar
factor U of the shifted covariance A - s*I, found by the dynamically weighted
Halley iteration in its QR form (no inverse, six rounds or so), is the matrix sign
of it, and (U + I) / 2 the spectral projector on the eigenvalues above s. Bases of
its range and of its complement split A into two smaller blocks, each split on
until a block is one number or a multiple of the identity. The components are then
handed to all tasks (at most 32 x d numbers), which whiten their rows; a last pass
gathers the covariance of the whitened rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STEPS, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Sums of squares of rows (deviation) must fit in a long.
_LONG = 2**63 - 1


# ---- the d x d problem --------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix, by QR-based dynamically weighted
    Halley iterations. Singular values are lifted to 1 from a lower bound that starts
    at rounding size, so nearly singular matrices take six or seven rounds."""
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0.0:
        return np.eye(n)
    x, low, eps = a / norm, np.finfo(float).eps / 2, np.finfo(float).eps
    for _ in range(40):
        sq = low * low
        root = np.cbrt(4.0 * (1.0 - sq) / (sq * sq))
        w = np.sqrt(1.0 + root) + 0.5 * np.sqrt(8.0 - 4.0 * root + 8.0 * (2.0 - sq) / (sq * np.sqrt(1.0 + root)))
        b = (w - 1.0) ** 2 / 4.0
        c = w + b - 1.0
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        new = (b / c) * x + ((w - b / c) / np.sqrt(c)) * (q[:n] @ q[n:].T)
        low = min(1.0, low * (w + b * sq) / (1.0 + c * sq))
        moved, x = np.linalg.norm(new - x), new
        if low > 1.0 - 10 * eps and moved < np.cbrt(4 * eps):
            # one plain Newton-Schulz step leaves only rounding errors
            return 1.5 * x - 0.5 * x @ (x.T @ x)
    return x


def _range(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis of a projector's range: random start, two power steps."""
    basis = np.linalg.qr(projector @ rng.standard_normal((len(projector), rank)))[0]
    return np.linalg.qr(projector @ basis)[0]


def _split(a: np.ndarray, shift: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below ``shift``; None if one is empty
    or if the shift is too close to an eigenvalue to tell them apart."""
    n = len(a)
    sign = polar(a - shift * np.eye(n))
    sign = (sign + sign.T) / 2
    rank = int(round((np.trace(sign) + n) / 2))
    if not 0 < rank < n:
        return None
    up = _range((np.eye(n) + sign) / 2, rank, rng)
    down = _range((np.eye(n) - sign) / 2, n - rank, rng)
    off = np.abs(up.T @ a @ down).max()
    return (up, down) if off <= 1e-13 * n * max(np.abs(a).max(), 1e-300) and np.abs(up.T @ down).max() <= 1e-10 else None


def spectral(a: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    n, rng = len(a), np.random.default_rng(seed)
    tiny = np.finfo(float).eps * max(np.linalg.norm(a), 1e-300)
    values, columns = [], []
    todo = [(a, np.eye(n))]
    while todo:
        block, basis = todo.pop()
        m = len(block)
        mean = np.trace(block) / m if m else 0.0
        spread = np.linalg.norm(block - mean * np.eye(m))
        if m == 0:
            continue
        if m == 1 or spread <= tiny:
            values += [mean] * m
            columns.append(basis)
            continue
        diagonal = np.sort(np.diag(block))
        # the middle of the diagonal splits well; if it hits an eigenvalue, try others
        scale = spread / np.sqrt(m)
        shifts = [np.median(diagonal), mean, *(mean + scale * t for t in rng.uniform(-1, 1, 20))]
        for shift in shifts:
            parts = _split(block, float(shift), rng)
            if parts is not None:
                break
        else:
            raise ArithmeticError("no shift splits the spectrum")
        for part in parts:
            small = part.T @ block @ part
            todo.append(((small + small.T) / 2, basis @ part))
    vectors = np.hstack(columns) if columns else np.zeros((0, 0))
    # Rayleigh quotients on the whole matrix: rounding errors of the splits don't add up
    e = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-e, kind="stable")
    return e[order], vectors[:, order]


# ---- passes over the rows -------------------------------------------------------


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), dim)


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the integer vector, of every row whose vector is neither null nor
    holds a null or non-finite entry."""
    entry = F.col("_v")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # beyond 2^46 the steps of a double are coarser than the steps of x
    small = F.forall(entry, lambda c: F.abs(c) < F.lit(float(2**46)))
    rows = rows.filter(entry.isNotNull()).filter(finite)
    x = F.transform(entry, lambda c: F.floor(c * F.lit(float(STEPS))).cast("long") + F.lit(SHIFT).cast("long"))
    return rows.select("vec_id", F.when(small, x).otherwise(F.raise_error(F.lit("an entry is beyond 2^46")).cast("array<bigint>")).alias("x"))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Count and per-dimension sums, exact. Of vectors of several lengths, the length
    that most rows have (the larger one of a tie) is the dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.asarray(column.value_lengths())
            for dim in np.unique(sizes).tolist():
                picked = column.take(pa.array(np.flatnonzero(sizes == dim)))
                x = _matrix(picked, dim)
                if x.size and int(np.abs(x).max()) * len(x) > _LONG:
                    x = x.astype(object)
                n, so_far = held.get(dim, (0, [0] * dim))
                held[dim] = (n + len(picked), [int(p) + int(q) for p, q in zip(so_far, x.sum(axis=0), strict=True)])
        dims = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims, pa.int32()), pa.array([held[k][0] for k in dims], pa.int64()), pa.array([[str(s) for s in held[k][1]] for k in dims], pa.list_(pa.string()))],
            names=["dim", "n", "s"],
        )

    # sums of one task may pass a long; decimals hold them
    parts = rows.select("x").mapInArrow(part, "dim int, n long, s array<string>")
    each = parts.select("dim", "n", F.posexplode_outer("s").alias("i", "s"))
    each = each.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    counts = {r["dim"]: r["n"] for r in each}
    if not counts:
        return 0, []
    dim = max(counts, key=lambda k: (counts[k], k))
    return counts[dim], [int(r["s"]) for r in sorted((r for r in each if r["dim"] == dim and dim), key=lambda r: r["i"])]


def _centred(x: np.ndarray, n: int, s: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n in doubles, from the integer part of S/n and the remainder."""
    return (x - s).astype(np.float64) - rest / n


def _covariance(rows: DataFrame, dim: int, project, width: int) -> np.ndarray:
    """The mean outer product of ``project`` of the rows: a block of sums a task, summed
    by its rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width, width)), 0
        for batch in batches:
            if batch.num_rows:
                y = project(_matrix(batch.column(0), dim))
                total += y.T @ y
                n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array([n] * width, pa.int64()), pa.array(list(total), pa.list_(pa.float64()))],
                names=["i", "n", "c"],
            )

    parts = rows.select("x").mapInArrow(part, "i int, n long, c array<double>")
    summed = parts.select("i", "n", F.posexplode("c").alias("j", "c")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    out = np.zeros((width, width))
    for r in summed.collect():  # width x width numbers, bounded by the dimension
        out[r["i"], r["j"]] = r["c"] / r["n"]
    return (out + out.T) / 2


class Whitener:
    """Fitted on all rows: count, sums, components and what they explain."""

    def __init__(self, rows: DataFrame, components: int = COMPONENTS) -> None:
        self.n, self.sums = sums(rows)
        self.dim = len(self.sums)
        self.rows = rows.filter(F.size("x") == self.dim) if self.n else rows.limit(0)
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.float64)
        n = self.n
        self.centred = lambda x: _centred(x, n, whole, rest)
        if not self.dim:
            self.values, self.explained, self.map, self.identity_error = np.zeros(0), np.zeros(0), np.zeros((0, 0)), None
            return
        covariance = _covariance(self.rows, self.dim, self.centred, self.dim)
        values, vectors = spectral(covariance)
        total = float(np.trace(covariance))
        self.values = values[:components]
        self.explained = self.values / total if total > 0 else np.zeros(len(self.values))
        # a direction without variance beyond rounding can't be scaled to one
        self.real = self.values > 1e-13 * self.dim * max(float(values[0]), 1e-300)
        scale = np.where(self.real, 1.0 / np.sqrt(np.where(self.real, self.values, 1.0)), 0.0)
        self.map = vectors[:, :components] * scale
        centred, to = self.centred, self.map
        self.identity_error = None
        if self.real.any():
            got = _covariance(self.rows, self.dim, lambda x: centred(x) @ to, len(self.values))
            self.identity_error = float(np.abs(got - np.eye(len(got)))[np.ix_(self.real, self.real)].max())

    def apply(self) -> DataFrame:
        """vec_id, deviation, and whitened (an array, null where a component has no variance)."""
        n, sums_, dim, centred, to = self.n, self.sums, self.dim, self.centred, self.map
        real = getattr(self, "real", np.zeros(0, bool))
        vec_type = self.rows.schema["vec_id"].dataType.simpleString()

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), dim)
                # n*x - S, exact: in longs where they hold it, else in Python's integers
                top = int(np.abs(x).max()) if x.size else 0
                fits = (n * top + max(map(abs, sums_), default=0)) < 2**62
                y = n * x - np.array(sums_, np.int64) if fits else n * x.astype(object) - np.array(sums_, object)
                largest = int(np.abs(y).max()) if y.size else 0
                if largest * largest * max(dim, 1) > _LONG:
                    y = y.astype(object)
                deviation = [int(v) for v in (y * y).sum(axis=1)]
                if deviation and max(deviation) > _LONG:
                    raise OverflowError("a deviation passes the range of a long")
                white = centred(x) @ to
                mask = np.broadcast_to(~real, white.shape).reshape(-1)
                offsets = np.arange(0, white.size + 1, white.shape[1]) if white.shape[1] else np.zeros(len(x) + 1)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(white.reshape(-1), mask=mask))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "whitened"])

        return self.rows.select("vec_id", "x").mapInArrow(part, f"vec_id {vec_type}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row a kept vector and component: vec_id, component (from 1, by falling
    eigenvalue), n, deviation (sum of squares of n*x - S, exact), whitened, explained,
    identity_error.

    Input: an id and a vector column; others are ignored. A vector that is null or holds
    null or non-finite entries is dropped, and so is one whose length is not that of
    most rows. A null id and repeated rows count as rows like others. A component
    without variance has null whitened values and stays out of identity_error, which is
    null if no component has any (one row, equal rows). An empty table gives no rows, and
    so do vectors without entries. Entries from 2^46 on, and deviations beyond a long,
    are errors.
    """
    fitted = Whitener(quantised(vectors, id_col, vector_col), components)
    explained = F.array(*(F.lit(float(v)) for v in fitted.explained)) if len(fitted.explained) else F.array().cast("array<double>")
    error = F.lit(fitted.identity_error).cast("double")
    each = fitted.apply().select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(
        "vec_id",
        (F.col("_k") + 1).alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_k")).alias("explained"),
        error.alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
