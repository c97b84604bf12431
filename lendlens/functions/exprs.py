"""Column expressions shared by the operators.

All helpers return :class:`pyspark.sql.Column` built from built-in functions, so
they stay inside whole-stage codegen (no Python UDFs).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dlit(x: float) -> Column:
    """A DOUBLE literal (a Python float literal in Spark SQL text is DECIMAL)."""
    return F.lit(float(x)).cast("double")


def ieee_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """IEEE-754 division: x/0 is +inf, -inf or NaN instead of an ANSI error."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return (
        F.when(b != 0, a / b)
        .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.isnan(a) | (a == 0), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )


def safe_divide(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Division that yields NULL for a zero divisor."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def nan_to_null(c: ColumnOrName) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def exceeds(c: ColumnOrName, threshold: float, default: float) -> Column:
    """``COALESCE(c, default) > threshold`` where NaN never exceeds.

    Spark sorts NaN above every number; the audited warehouse does not, so NaN
    is mapped to ``default`` before comparing.
    """
    c = col(c)
    return F.coalesce(nan_to_null(c), dlit(default)) > dlit(threshold)


def below(c: ColumnOrName, threshold: float, default: float) -> Column:
    """``COALESCE(c, default) < threshold`` where NaN is never below."""
    c = col(c)
    return F.coalesce(c, dlit(default)) < dlit(threshold)


def guarded_least(cap: float, c: ColumnOrName) -> Column:
    """``LEAST(cap, c)`` that is NULL when ``c`` is NULL (Spark's skips NULL)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(dlit(cap), c.cast("double")))


def band(c: ColumnOrName, bands: Sequence[tuple[float, str]], default: str) -> Column:
    """Label ``c`` by the first ``(lower_bound, label)`` with ``c >= lower_bound``.

    ``bands`` is ordered from the highest bound down; NULL falls to ``default``.
    """
    c = col(c)
    expr = None
    for bound, label in bands:
        cond = c >= F.lit(bound)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(default) if expr is not None else F.lit(default)


def label_map(c: ColumnOrName, mapping: Mapping[Any, Any], default: Any = None) -> Column:
    """Simple CASE: ``CASE c WHEN k THEN v ... ELSE default END``."""
    c = col(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    if default is None:
        return expr
    return expr.otherwise(F.lit(default))


def md5_unit(key: ColumnOrName, salt: str, modulus: int = 1000) -> Column:
    """Deterministic pseudo-uniform integer in ``[0, modulus)`` from md5(key||salt).

    Replaces RAND() so runs are replayable and checkable in another engine:
    ``int(first 7 hex digits of md5(key || salt)) mod modulus``.
    """
    hexed = F.substring(F.md5(F.concat(col(key).cast("string"), F.lit(salt))), 1, 7)
    return F.conv(hexed, 16, 10).cast("bigint") % F.lit(modulus)


def stable_hash64(key: ColumnOrName) -> Column:
    """Non-negative 60-bit hash of a string key (first 15 hex digits of md5)."""
    return F.conv(F.substring(F.md5(col(key).cast("string")), 1, 15), 16, 10).cast("bigint")


def num_text(c: ColumnOrName, digits: int | None = None) -> Column:
    """Number rendered the way the audited warehouse casts FLOAT64 to STRING.

    ``ROUND(x)`` texts have no fractional part (``150`` not ``150.0``); other
    values use the shortest round-trip text with a trailing ``.0`` removed.
    """
    c = col(c).cast("double")
    if digits == 0:
        return F.round(c).cast("bigint").cast("string")
    if digits is not None:
        c = F.round(c, digits)
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def join_nonnull(sep: str, parts: Iterable[Column]) -> Column:
    """``ARRAY_TO_STRING([...], sep)`` with NULL elements dropped."""
    return F.concat_ws(sep, *parts)


def round_doubles(df, digits: int = 6):
    """Round every top-level DOUBLE column (engine-independent comparisons)."""
    out = []
    for field in df.schema.fields:
        if field.dataType.typeName() == "double":
            out.append(F.round(F.col(field.name), digits).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)
