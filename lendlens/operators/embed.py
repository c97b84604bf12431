"""Text embedding over a table (M1) and the two-kind embedding table.

The audited script calls a remote text model through ``ML.GENERATE_EMBEDDING``.
Here an embedder is any of:

* ``hash_embedding`` -- feature hashing (token -> md5 bucket, signed count,
  L2-normalised) written with higher-order functions, so it runs in the JVM
  with no Python worker and no network;
* a Python callable ``pandas.Series[str] -> list[list[float]]`` (an ONNX or
  tokenizer model, say), run as an Arrow-batched pandas UDF;
* a vector table joined by key (``table_vectors``), used by the adapter.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dlit

EMBEDDING_COLUMNS = [
    "application_id", "lei", "state_code", "profile_text", "race_category",
    "ethnicity_category", "gender_category", "approved", "profile_embedding",
    "financial_embedding", "income", "loan_amount", "calculated_dti_ratio", "rate_spread_adj",
]


def tokens(text: Column) -> Column:
    """Lower-cased alphanumeric tokens of ``text``."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: F.length(t) > 0)


def _token_hash(t: Column, dim: int) -> tuple[Column, Column]:
    slot = (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring(F.md5(t), 9, 1), 16, 10).cast("int") % 2 == 0, dlit(1.0)).otherwise(dlit(-1.0))
    return slot, sign


def hash_embedding_sparse(df: DataFrame, id_col: str, text_col: str, dim: int = 64, unique_ids: bool = False) -> DataFrame:
    """Feature-hashing embedding as sparse rows ``(id, slot, value)``.

    Token ``t`` adds ``+1`` or ``-1`` (md5 hex digit 9 even/odd) to slot
    ``int(md5(t)[0:8], 16) mod dim``; the vector is L2-normalised; zero slots
    are not emitted. Tokens are exploded and summed with a (partial + final)
    aggregate on ``(id, slot)``; the norm is a window over one document's
    non-zero slots (at most ``dim`` rows). All of it runs in generated code.

    ``unique_ids``: every row has an id of its own, so a row's text is the whole
    document and its vector needs no shuffle (:func:`hash_embedding`); otherwise
    the texts of equal ids are one document.
    """
    if unique_ids:
        each = df.select(id_col, F.posexplode(hash_embedding(F.col(text_col), dim)).alias("slot", "value"))
        return each.where(F.col("value") != 0)
    tok = df.select(F.col(id_col), F.explode(tokens(F.col(text_col))).alias("_t"))
    slot, sign = _token_hash(F.col("_t"), dim)
    counts = (
        tok.select(id_col, slot.alias("slot"), sign.alias("_sign"))
        .groupBy(id_col, "slot")
        .agg(F.sum("_sign").alias("_count"))
        .where(F.col("_count") != 0)
    )
    norm = F.sqrt(F.sum(F.col("_count") * F.col("_count")).over(Window.partitionBy(id_col)))
    return counts.select(id_col, "slot", (F.col("_count") / norm).alias("value"))


_SPLIT = re.compile(r"[^a-z0-9]+")


def _hash_matrix(texts: list[str], dim: int) -> np.ndarray:
    """The vectors of one Arrow batch: every distinct token is hashed once, and the signs
    are summed by array operations (same definition as the sparse form)."""
    vocabulary: dict[str, int] = defaultdict(itertools.count().__next__)
    number = vocabulary.__getitem__
    found = [_SPLIT.split(text.lower()) for text in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    at = np.fromiter(map(number, itertools.chain.from_iterable(found)), np.int64, int(sizes.sum()))
    digests = [hashlib.md5(t.encode("utf-8")).digest() for t in vocabulary]
    slot = np.array([int.from_bytes(d[:4], "big") % dim for d in digests], dtype=np.int64)
    # the ninth hex digit is the upper half of the fifth byte; no token is empty
    sign = np.array([(1.0 - 2.0 * ((d[4] >> 4) % 2)) if t else 0.0 for t, d in zip(vocabulary, digests, strict=True)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    vectors = np.bincount(row * dim + slot[at], weights=sign[at], minlength=len(sizes) * dim).reshape(len(sizes), dim)
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1.0)


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Dense ``array<double>`` form of the feature-hashing embedding. Summing by slot
    within a row would cost tokens x dim interpreted steps in the JVM, so this is an
    Arrow UDF that hashes each distinct token of a batch once. NULL text gives NULL."""

    @F.arrow_udf("array<double>")
    def _embed(texts: pa.Array) -> pa.Array:
        present = texts.is_valid()
        if not len(texts) or not pc.any(present).as_py():
            return pa.nulls(len(texts), pa.list_(pa.float64()))
        flat = _hash_matrix(texts.drop_null().to_pylist(), dim).ravel()
        ends = np.append(0, np.cumsum(present.to_numpy(zero_copy_only=False))) * dim
        mask = pc.invert(present) if texts.null_count else None
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=mask)

    return _embed(text)


def python_embedder(fn: Callable) -> Callable[[Column], Column]:
    """Wrap ``fn(pandas.Series[str]) -> sequence of vectors`` as a column function.

    Runs as a scalar pandas UDF: Arrow batches, one Python call per batch.
    """

    @F.pandas_udf("array<double>")
    def _embed(texts: pd.Series) -> pd.Series:
        present = texts.notna().tolist()
        vecs = iter(fn(texts[texts.notna()]) if any(present) else ())
        return pd.Series([[float(x) for x in next(vecs)] if ok else None for ok in present])

    return lambda text: _embed(text)


def embed_text(df: DataFrame, text_col: str, out_col: str, embedder: Callable[[Column], Column] | None = None,
               dim: int = 64) -> DataFrame:
    """M1: add ``out_col`` holding the embedding of ``text_col`` for every row."""
    fn = embedder or (lambda t: hash_embedding(t, dim))
    return df.withColumn(out_col, fn(F.col(text_col)))


FINANCIAL_DIM = 4


def financial_vector(scale_income: float = 200.0, scale_loan: float = 500.0) -> Column:
    """Numeric financial vector ``[income/200, loan/500, dti, (spread+1)/4]``."""
    return F.array(
        F.col("income") / dlit(scale_income),
        F.col("loan_amount") / dlit(scale_loan),
        F.col("calculated_dti_ratio"),
        (F.coalesce(F.col("rate_spread_adj"), dlit(0.0)) + dlit(1.0)) / dlit(4.0),
    )


def _has_financials() -> Column:
    return (
        F.col("income").isNotNull() & F.col("loan_amount").isNotNull()
        & F.col("calculated_dti_ratio").isNotNull() & F.col("rate_spread_adj").isNotNull()
    )


def numeric_vector() -> Column:
    """The financial vector, null where one of the four numbers is missing."""
    return F.when(_has_financials(), financial_vector())


def _has_text() -> Column:
    """Neither null nor blank, in one look at the text (it is put together for this, if it isn't stored)."""
    return F.coalesce(F.trim(F.col("profile_text")), F.lit("")) != ""


def embed_applications(
    profiles: DataFrame,
    profile_embedder: Callable[[Column], Column] | None = None,
    financial_embedder: Callable[[Column], Column] | None = None,
    dim: int = 64,
    has_text: Column | None = None,
) -> DataFrame:
    """M2 / T3 with text embedders: both kinds embedded column-wise.

    Equivalent to embedding the union of profile and financial texts and
    joining the two kinds back: rows whose profile text is NULL or blank have
    no profile embedding and are dropped (semi-join); the financial embedding
    is NULL where any financial number is missing (left join). ``has_text`` tells such rows
    from other columns than the text (:func:`features.has_profile_text`).
    """
    from .features import financial_text

    prof = profile_embedder or (lambda t: hash_embedding(t, dim))
    fin = financial_embedder or (lambda t: hash_embedding(t, dim))
    kept = profiles.where(_has_text() if has_text is None else has_text)
    return kept.withColumns(
        {
            "profile_embedding": prof(F.col("profile_text")),
            "financial_embedding": F.when(_has_financials(), fin(financial_text())),
        }
    ).select(*EMBEDDING_COLUMNS)


def attach_table_vectors(
    profiles: DataFrame,
    vectors: DataFrame,
    key_col: str = "source_key",
    scalars: Callable[[str], dict[str, Column]] | None = None,
    has_text: Column | None = None,
) -> DataFrame:
    """T3 from a vector table (adapter): profile vector = ``vectors[key mod E]``.

    Vector ids are 0..E-1; an application whose vector is missing fails the job.
    ``E`` (the vector count) is a scalar subquery, not a cross join; the
    lookup is an equi-join on ``vec_id`` that AQE broadcasts only when the
    vector table is measured small. The financial embedding is the numeric
    :func:`financial_vector`. ``scalars`` names columns derived from a vector column
    (:func:`clusters.lead_columns`); they are derived before the lookup, so a reader of
    them alone moves no vectors. ``has_text`` as in :func:`embed_applications`.
    """
    n_vectors = vectors.select(F.count(F.lit(1)).cast("bigint")).scalar()
    kept = profiles.where(_has_text() if has_text is None else has_text)
    keyed = kept.withColumn("_vec_id", F.col(key_col) % n_vectors)
    derived = scalars("vector") if scalars else {}
    known = F.col("vector").isNotNull()
    held = vectors.select(F.col("vec_id").alias("_vec_id"), "vector", known.alias("_known"), *(c.alias(n) for n, c in derived.items()))
    joined = keyed.join(held, "_vec_id", "left")
    missing = F.raise_error(F.concat(F.lit("no vector with id "), F.col("_vec_id").cast("string")))
    return joined.withColumns(
        {
            # ids that are not 0..E-1 must not lose applications
            "profile_embedding": F.when(F.col("_known"), F.col("vector")).otherwise(missing),
            **{n: F.when(F.col("_known"), F.col(n)).otherwise(missing) for n in derived},
            "financial_embedding": numeric_vector(),
        }
    ).select(*EMBEDDING_COLUMNS, *derived)
