"""Vector maths on ``array<double>`` columns with higher-order functions.

These run inside the JVM (``aggregate``/``zip_with``), so no Python worker is
involved for distances.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import ColumnOrName, col


def as_double_array(c: ColumnOrName) -> Column:
    return col(c).cast("array<double>")


# Vectors up to this length may be unrolled into plain arithmetic when their
# length is known: generated code instead of interpreted lambdas.
UNROLL_MAX = 32


def dot(a: ColumnOrName, b: ColumnOrName, dim: int | None = None) -> Column:
    """Left-to-right sum of products (same order either way)."""
    if dim is not None and dim <= UNROLL_MAX:
        a, b = col(a), col(b)
        out = F.get(a, 0) * F.get(b, 0)
        for i in range(1, dim):
            out = out + F.get(a, i) * F.get(b, i)
        return out
    prods = F.zip_with(col(a), col(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sum_squares(a: ColumnOrName, dim: int | None = None) -> Column:
    if dim is not None and dim <= UNROLL_MAX:
        return dot(a, a, dim)
    return F.aggregate(col(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2_norm(a: ColumnOrName, dim: int | None = None) -> Column:
    return F.sqrt(sum_squares(a, dim))


def normalize(a: ColumnOrName) -> Column:
    """Unit-length copy of ``a`` (a zero vector stays zero)."""
    a = col(a)
    # the norm as a bound variable: within the lambda it would be summed anew for every element
    scaled = F.get(F.transform(F.array(l2_norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n))), 0)
    return F.coalesce(scaled, a)


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``1 - a.b / (|a| |b|)``; NULL when either side is NULL or zero-length."""
    denom = l2_norm(a) * l2_norm(b)
    return F.when(denom > 0, F.lit(1.0) - dot(a, b) / denom)


def squared_euclidean(a: ColumnOrName, b: ColumnOrName) -> Column:
    diffs = F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def euclidean(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def element(a: ColumnOrName, i: int) -> Column:
    """``a[SAFE_OFFSET(i)]``: 0-based, NULL when out of range (no ANSI error)."""
    return F.get(col(a), i)
