"""Similarity pairs within a lender/state block (M3, M4; T6).

Semantics (per block, ``base.id < similar.id``):

1. band: income and loan of one within 0.5x-2.0x of the other, |dDTI| < 0.2;
2. cosine distance of the financial embeddings < ``max_distance``;
3. income / loan relative difference < 10 %, |dDTI| < 0.05;
4. top ``k`` per base by (distance, income diff, loan diff, DTI diff, id);
5. demographic / outcome / strength labels.

Plan shape. A block self-join is quadratic in the block, and one lender may
hold a third of all applications. Each band predicate is a bounded distance
in one coordinate (``ln income``, ``ln loan``, DTI), so rows are put in cells
of twice the tolerance; a partner then lies in the row's own cell or in the
neighbour on the near side of it. The base side keeps its own cell, the
similar side is exploded to the cells a partner can be in (own cell, plus the
neighbour it is close to, per coordinate: at most 8), and the pair search
becomes an equi-join on ``(lei, state, cell_i, cell_l, cell_d)`` that splits
even a hot block across many tasks. A cell that still holds more than
``HEAVY_CELL`` rows would compare all its rows with each other: for a top ``k``
it is searched leaf by leaf instead (:mod:`dense_pairs`), which looks at a number
of pairs about linear in its rows. Without a top ``k`` all its pairs are the
output, and it is dealt over salts: base rows by their id, similar rows copied to
every salt. Copies cost more than comparisons while blocks are small, so for a top
``k`` loan and DTI get cells only where a row's block holds more than ``CELL_ROWS`` rows
on average over all rows. Every
predicate is re-checked exactly on the joined rows, so cells and leaves only prune (no
pair is lost or added). A base row stays in one cell, so its top ``k`` is found where
the join left its pairs, without a shuffle of them.
Vectors of a known short length (``vector_dim``) go along with the cell join, so
that only pairs within the distance are shuffled by their base id. Those of a known
longer length would make its rows wide and be compared by interpreted arithmetic, so
for a top ``k`` the rows of a cell are dealt to one task with their vectors packed
(:mod:`cell_pairs`). Vectors of unknown length stay out of the join and are fetched by
id for the pairs that passed the scalar predicates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dlit, safe_divide
from ..functions.vectors import dot, l2_norm
from ..sources import sinks
from . import cell_pairs, dense_pairs

# ---- fixed values of the audit -------------------------------------------------
MAX_DISTANCE = 0.05
BAND_LOW, BAND_HIGH, BAND_DTI = 0.5, 2.0, 0.2
INCOME_TOL, LOAN_TOL, DTI_TOL = 0.1, 0.1, 0.05
TOP_K = 5
RACE_DIFFERENCE = "RACE_DIFFERENCE"
GENDER_DIFFERENCE = "GENDER_DIFFERENCE"
ETHNICITY_DIFFERENCE = "ETHNICITY_DIFFERENCE"
SAME_DEMOGRAPHICS = "SAME_DEMOGRAPHICS"
OUTCOME_DIFFERENCE = "OUTCOME_DIFFERENCE"
SAME_OUTCOME = "SAME_OUTCOME"
STRENGTH_BANDS = [(0.01, "VERY_HIGH_SIMILARITY"), (0.03, "HIGH_SIMILARITY")]
STRENGTH_DEFAULT = "MEDIUM_SIMILARITY"
# ---------------------------------------------------------------------------------

#: Rows of a cell that are compared pair by pair with their partners.
HEAVY_CELL = 2000
#: Rows of a row's block, on average, beyond which loan and DTI get cells as well as income.
CELL_ROWS = {"_cl": 150, "_cd": 1500}
#: Rows of the largest block up to which income cells are enough where a cell's rows are searched by their loans
#: (:mod:`cell_pairs`), as copies hold whole vectors.
PACKED_BLOCK = 8000
#: Numbers of a vector up to which it goes along with the cell join.
CARRIED_DIM = 8

_SLACK = 1.0 + 1e-6
_SIDE_COLS = ["application_id", "race_category", "gender_category", "ethnicity_category", "approved",
              "income", "loan_amount", "calculated_dti_ratio"]
_SIDE_NAMES = {
    "application_id": "app_id", "race_category": "race", "gender_category": "gender",
    "ethnicity_category": "ethnicity", "approved": "approved", "income": "income",
    "loan_amount": "loan_amount", "calculated_dti_ratio": "dti",
}

#: Those that the pairs of a cell are judged by, under their names there.
_SCALARS = {"application_id": "_id", "income": "_income", "loan_amount": "_loan", "calculated_dti_ratio": "_dti"}

PAIR_COLUMNS = [
    "base_app_id", "lei", "state_code", "base_race", "base_gender", "base_ethnicity", "base_approved",
    "base_income", "base_loan_amount", "base_dti", "similar_app_id", "similar_race", "similar_gender",
    "similar_ethnicity", "similar_approved", "similar_income", "similar_loan_amount", "similar_dti",
    "financial_similarity_distance", "income_diff_ratio", "loan_amount_diff_ratio", "dti_abs_diff",
    "demographic_difference_type", "outcome_difference_type", "similarity_strength",
]


def _cells(value: Column, half_width: float, cell_factor: float) -> tuple[Column, Column]:
    """Own cell of ``value`` (width ``cell_factor * half_width``) and the array
    of cells a partner within ``half_width`` may sit in: the own cell, plus a
    neighbour only when ``value`` lies within ``half_width`` of that border."""
    width = cell_factor * half_width
    pos = value / dlit(width)
    own = F.floor(pos).cast("bigint")
    frac = (pos - own) * dlit(width)  # distance to the lower border
    reach = dlit(half_width * _SLACK)
    lower = F.when(frac < reach, F.array(own - 1)).otherwise(F.array().cast("array<bigint>"))
    upper = F.when(dlit(width) - frac < reach, F.array(own + 1)).otherwise(F.array().cast("array<bigint>"))
    return own, F.concat(F.array(own), lower, upper)


def _dims(income_half: float, loan_half: float, dti_half: float) -> list[tuple[str, Column, float]]:
    return [
        ("_ci", F.log(F.col("income")), income_half),
        ("_cl", F.log(F.col("loan_amount")), loan_half),
        ("_cd", F.col("calculated_dti_ratio"), dti_half),
    ]


def _side(apps: DataFrame, prefix: str, block: Sequence[str], vector_col: str | None,
          dim: int | None = None, cells: Sequence[str] = ("_ci", "_cl", "_cd")) -> DataFrame:
    cols = [F.col(c).alias(c) for c in block]
    cols += [F.col(c).alias(f"{prefix}_{_SIDE_NAMES[c]}") for c in _SIDE_COLS]
    if vector_col is not None:
        cols += [F.col(vector_col).alias(f"{prefix}_vec"), l2_norm(F.col(vector_col), dim).alias(f"{prefix}_norm")]
    cols += [F.col(c) for c in cells]
    return apps.select(*cols)


def pair_candidates(
    apps: DataFrame,
    block: Sequence[str],
    income_half: float,
    loan_half: float,
    dti_half: float,
    vector_col: str | None = "financial_embedding",
    vector_dim: int | None = None,
    cell_factor: float = 4.0,
    heavy_cell: int = HEAVY_CELL,
    both_directions: bool = False,
) -> DataFrame:
    """All (base, similar) pairs of a block whose three coordinates are within
    the given half-widths (log scale for income and loan), as an equi-join.

    Cells are ``cell_factor`` half-widths wide (>= 1). The base side keeps its
    own cell; the similar side is exploded into its own cell and, per
    coordinate, the neighbour it is close to: 2^3 copies at factor 2, about
    1.5^3 at factor 4 (fewer copies in the shuffle, larger cells to filter).
    Returns base_*/similar_* columns (and vectors + norms unless
    ``vector_col`` is None)."""
    if cell_factor < 1.0:
        raise ValueError("cell_factor must be >= 1")
    dims = _dims(income_half, loan_half, dti_half)
    own, reach = {}, {}
    for name, value, half in dims:
        own[name], reach[name] = _cells(value, half, cell_factor)
    keys = list(block) + ["_ci", "_cl", "_cd"]
    celled = apps.withColumns(own)
    base = _side(celled, "base", block, vector_col, vector_dim)
    similar_src = celled
    for name, _, _ in dims:
        similar_src = similar_src.withColumn(name, F.explode(reach[name]))
    similar = _side(similar_src, "similar", block, vector_col, vector_dim)
    base, similar = _salted(base, similar, keys, heavy_cell)
    apart = F.col("base_app_id") != F.col("similar_app_id")
    order = apart if both_directions else F.col("base_app_id") < F.col("similar_app_id")
    return base.join(similar, [*keys, "_salt"]).where(order)


def top_candidates(
    apps: DataFrame, block: Sequence[str], halves: tuple[float, float, float], limits: dense_pairs.Limits,
    vector_col: str, vector_dim: int | None, cell_factor: float, heavy_cell: int,
) -> list[tuple[DataFrame, list[str]]]:
    """Pairs that hold every base row's top ``k``, with the columns that its pairs are together by: all of the cells
    with at most ``heavy_cell`` rows (their predicates are left to the caller), and the searched ones of the denser
    cells. A base row's pairs are all in one of the two.

    Counting the blocks is a job of its own over two columns. Where none has more than ``heavy_cell`` rows, no cell
    has; else the cells are counted as well, and where none is dense the plan is the plain cell join (or the
    search of packed rows)."""
    # a short vector goes along with the join, a long one with the packed rows of a cell, others are fetched by id
    together = vector_dim is not None and vector_dim > CARRIED_DIM
    carried = vector_col if vector_dim is not None and vector_dim <= CARRIED_DIM else None

    def side(rows: DataFrame, prefix: str, cells: Sequence[str]) -> DataFrame:
        return _side(rows, prefix, block, carried, vector_dim, cells)

    c = F.col
    order = c("base_app_id") != c("similar_app_id") if limits.both_directions else c("base_app_id") < c("similar_app_id")
    # the cheapest predicates first, and the order of texts last; the caller checks the ratios themselves
    near = F.abs(c("base_dti") - c("similar_dti")) < dlit(limits.dti_tol)
    for name, tol in (("income", limits.income_tol), ("loan_amount", limits.loan_tol)):
        a, b = c(f"base_{name}"), c(f"similar_{name}")
        near = near & (F.abs(a - b) <= F.greatest(a, b) * dlit(tol * _SLACK))
    order = near & order
    n = c("_rows").cast("double")
    sizes = apps.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max(n), F.sum(n * n) / F.sum(n)).first()
    largest, mean = (x or 0.0 for x in sizes)
    dims = [d for d in _dims(*halves) if mean > CELL_ROWS.get(d[0], -1)]
    if together and largest <= PACKED_BLOCK:
        dims = dims[:1]
    own, reach = {}, {}
    for name, value, half in dims:
        own[name], reach[name] = _cells(value, half, cell_factor)
    keys = [*block, *own]
    celled = apps.withColumns(own)
    copied = celled
    for name in own:
        copied = copied.withColumn(name, F.explode(reach[name]))
    base, similar = side(celled, "base", own), side(copied, "similar", own)
    rows = None
    if largest > heavy_cell:
        dense = celled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(c("_n") > heavy_cell)
        dense = sinks.scratch_table(dense, "dense_cells")
        rows = dense.agg(F.sum("_n")).first()[0]
    home = F.lit(True)
    for name, column in own.items():
        home = home & (column == F.col(name))

    def packed(cells: DataFrame | None) -> DataFrame:
        """The copies of all cells but ``cells``, with their vectors packed once a row."""
        rows = apps.where(F.col("application_id").isNotNull()).withColumns(cell_pairs.packed(F.col(vector_col))).drop(vector_col)
        for name in own:
            rows = rows.withColumn(name, F.explode(reach[name]))
        rows = rows if cells is None else rows.join(cells, keys, "left_anti")
        known = {"_own": home, "_id": c("application_id"), "_income": c("income"), "_loan": c("loan_amount"), "_dti": c("calculated_dti_ratio")}
        return rows.withColumns(known).select(*keys, *known, "_dim", "_bits", "_values", *(n for n in _SIDE_COLS if n not in _SCALARS))

    def few(cells: DataFrame | None) -> tuple[DataFrame, list[str]]:
        if together:
            sides = {_SCALARS.get(n, n): name for n, name in _SIDE_NAMES.items()}
            return cell_pairs.top_pairs(packed(cells), keys, block, sides, limits), keys
        if cells is None:
            return base.join(similar, keys).where(order), keys
        return base.join(cells, keys, "left_anti").join(similar.join(cells, keys, "left_anti"), keys).where(order), keys

    if rows is None:
        return [few(None)]
    cells = dense.select(*keys)
    copies = copied.join(cells, keys, "left_semi").select(
        *keys, home.alias("_own"), F.col("application_id").alias("_id"), F.col("income").alias("_income"),
        F.col("loan_amount").alias("_loan"), F.col("calculated_dti_ratio").alias("_dti"),
        l2_norm(F.col(vector_col), vector_dim).alias("_norm"), F.col(vector_col).alias("_vec"),
    )
    pieces = -(-int(rows * 3.4) // dense_pairs.PIECE_ROWS)
    found = dense_pairs.top_pairs(copies, keys, limits, pieces, sinks.scratch_table)
    either, other = side(apps, "base", ()), side(apps, "similar", ()).drop(*block)
    return [few(cells), (found.join(either, "base_app_id").join(other, "similar_app_id"), [])]


def _salted(base: DataFrame, similar: DataFrame, keys: list[str], heavy_cell: int) -> tuple[DataFrame, DataFrame]:
    """Add ``_salt``: in cells of more than ``heavy_cell`` base rows, base rows are dealt
    over ``rows / heavy_cell`` salts and similar rows copied to each of them."""
    heavy = (
        base.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > heavy_cell)
        .select(*keys, F.ceil(F.col("_rows") / F.lit(heavy_cell)).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    base = base.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("base_app_id"), salts).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), salts - 1))
    return base.drop("_salts"), similar.join(heavy, keys, "left").withColumn("_salt", copies).drop("_salts")


def _band(low: float, high: float, dti: float) -> Column:
    c = F.col
    return (
        c("base_income").between(c("similar_income") * dlit(low), c("similar_income") * dlit(high))
        & c("base_loan_amount").between(c("similar_loan_amount") * dlit(low), c("similar_loan_amount") * dlit(high))
        & (F.abs(c("base_dti") - c("similar_dti")) < dlit(dti))
    )


def similar_pairs(
    embedded: DataFrame,
    *,
    block: Sequence[str] = ("lei", "state_code"),
    vector_col: str = "financial_embedding",
    max_distance: float = MAX_DISTANCE,
    band_low: float = BAND_LOW,
    band_high: float = BAND_HIGH,
    band_dti: float = BAND_DTI,
    income_tol: float = INCOME_TOL,
    loan_tol: float = LOAN_TOL,
    dti_tol: float = DTI_TOL,
    top_k: int | None = TOP_K,
    vector_dim: int | None = None,
    cell_factor: float = 4.0,
    heavy_cell: int = HEAVY_CELL,
    both_directions: bool = False,
) -> DataFrame:
    """M4: financially similar pairs per block.

    ``vector_dim``: the vectors' length when it is known and fixed (the
    adapter's financial vector has 4 numbers); such vectors are compared with
    unrolled arithmetic instead of interpreted higher-order functions.

    ``both_directions``: every application looks for partners among all others
    of its block, not only among those with a larger id.

    All scalar predicates run before any vector arithmetic; they and the
    distance threshold are conjunctive filters ahead of the ranking, so the
    order does not change the result.
    """
    c = F.col
    apps = embedded.where(
        c("lei").isNotNull() & c("state_code").isNotNull() & c(vector_col).isNotNull()
        & (c("income") > 0) & (c("loan_amount") > 0)
        # a non-finite DTI can satisfy no |dDTI| < t predicate
        & ~F.isnan(c("calculated_dti_ratio"))
        & (F.abs(c("calculated_dti_ratio")) < dlit(float("inf")))
    )

    def log_width(tol: float) -> float:  # |a-b|/max(a,b) < tol  <=>  |ln a - ln b| < -ln(1 - tol)
        return -math.log(1.0 - tol) if tol < 1.0 else math.inf

    wide = (math.log(max(band_high, 1.0 / band_low)), math.log(max(band_high, 1.0 / band_low)), band_dti)
    tight = (log_width(income_tol), log_width(loan_tol), dti_tol)
    cells = tuple(min(a, b) for a, b in zip(wide, tight))
    if top_k is None:
        cand = pair_candidates(
            apps, block, *cells, vector_col=None, cell_factor=cell_factor, heavy_cell=heavy_cell,
            both_directions=both_directions,
        )
        parts = [(cand, [])]
    else:
        limits = dense_pairs.Limits(
            max_distance, band_low, band_high, band_dti, income_tol, loan_tol, dti_tol, top_k, both_directions
        )
        parts = top_candidates(apps, block, cells, limits, vector_col, vector_dim, cell_factor, heavy_cell)

    def scored(cand: DataFrame, together: list[str]) -> DataFrame:
        whole = "financial_similarity_distance" in cand.columns  # judged and ranked where its rows lay
        cand = cand if whole else cand.where(_band(band_low, band_high, band_dti))
        out = cand.withColumns(
            {
                "income_diff_ratio": safe_divide(F.abs(c("base_income") - c("similar_income")), F.greatest(c("base_income"), c("similar_income"))),
                "loan_amount_diff_ratio": safe_divide(F.abs(c("base_loan_amount") - c("similar_loan_amount")), F.greatest(c("base_loan_amount"), c("similar_loan_amount"))),
                "dti_abs_diff": F.abs(c("base_dti") - c("similar_dti")),
            }
        )
        if whole:
            return _labelled(out).select(*PAIR_COLUMNS)
        out = out.where(
            (F.coalesce(c("income_diff_ratio"), dlit(1.0)) < dlit(income_tol))
            & (F.coalesce(c("loan_amount_diff_ratio"), dlit(1.0)) < dlit(loan_tol))
            & (c("dti_abs_diff") < dlit(dti_tol))
        )
        if "base_vec" not in cand.columns:
            vecs = apps.select("application_id", c(vector_col).alias("_v"), l2_norm(c(vector_col), vector_dim).alias("_n"))
            out = (
                # the base side last: the top k per base id then runs on its partitioning
                out.join(vecs.toDF("similar_app_id", "similar_vec", "similar_norm"), "similar_app_id")
                .join(vecs.toDF("base_app_id", "base_vec", "base_norm"), "base_app_id")
            )
            together = []
        dist = F.when(
            (c("base_norm") > 0) & (c("similar_norm") > 0),
            dlit(1.0) - dot(c("base_vec"), c("similar_vec"), vector_dim) / (c("base_norm") * c("similar_norm")),
        )
        out = out.withColumn("financial_similarity_distance", dist).where(
            c("financial_similarity_distance") < dlit(max_distance)
        )
        if top_k is not None:
            # ids are spread evenly, so the top k of a base row needs no hot key
            w = Window.partitionBy(*together, "base_app_id").orderBy(
                "financial_similarity_distance", "income_diff_ratio", "loan_amount_diff_ratio", "dti_abs_diff", "similar_app_id"
            )
            out = out.withColumn("similarity_rank", F.row_number().over(w)).where(c("similarity_rank") <= top_k)
        return _labelled(out).select(*PAIR_COLUMNS)

    return reduce(DataFrame.unionByName, [scored(*part) for part in parts])


def _labelled(scored: DataFrame) -> DataFrame:
    c = F.col
    return scored.withColumns(
        {
            "demographic_difference_type": F.when(c("base_race") != c("similar_race"), RACE_DIFFERENCE)
            .when(c("base_gender") != c("similar_gender"), GENDER_DIFFERENCE)
            .when(c("base_ethnicity") != c("similar_ethnicity"), ETHNICITY_DIFFERENCE)
            .otherwise(SAME_DEMOGRAPHICS),
            "outcome_difference_type": F.when(c("base_approved") != c("similar_approved"), OUTCOME_DIFFERENCE).otherwise(SAME_OUTCOME),
            "similarity_strength": F.when(c("financial_similarity_distance") < dlit(STRENGTH_BANDS[0][0]), STRENGTH_BANDS[0][1])
            .when(c("financial_similarity_distance") < dlit(STRENGTH_BANDS[1][0]), STRENGTH_BANDS[1][1])
            .otherwise(STRENGTH_DEFAULT),
        }
    )


def cosine_distance_pairs(embedded: DataFrame, *, block: Sequence[str] = ("lei", "state_code"),
                          vector_col: str = "financial_embedding", max_distance: float = MAX_DISTANCE,
                          vector_dim: int | None = None, tight: bool = True, cell_factor: float = 4.0) -> DataFrame:
    """M3 + J1/J2: pairs of a block within the band and their cosine distance
    (below ``max_distance``), with no ranking.

    ``tight=True`` (default) uses the band the audit finally keeps (income and
    loan within 10 %, |dDTI| < 0.05), so the cells stay small; ``tight=False``
    uses the wide 0.5x-2x band, which inside a block approaches all pairs.
    """
    c = F.col
    apps = embedded.where(
        c("lei").isNotNull() & c("state_code").isNotNull() & c(vector_col).isNotNull()
        & (c("income") > 0) & (c("loan_amount") > 0)
        & ~F.isnan(c("calculated_dti_ratio")) & (F.abs(c("calculated_dti_ratio")) < dlit(float("inf")))
    )
    wide = math.log(max(BAND_HIGH, 1.0 / BAND_LOW))
    halves = (-math.log(1.0 - INCOME_TOL), -math.log(1.0 - LOAN_TOL), DTI_TOL) if tight else (wide, wide, BAND_DTI)
    cand = pair_candidates(apps, block, *halves, vector_col=vector_col, vector_dim=vector_dim,
                           cell_factor=cell_factor).where(_band(BAND_LOW, BAND_HIGH, BAND_DTI))
    if tight:
        cand = cand.where(
            (F.abs(c("base_income") - c("similar_income")) / F.greatest(c("base_income"), c("similar_income")) < dlit(INCOME_TOL))
            & (F.abs(c("base_loan_amount") - c("similar_loan_amount")) / F.greatest(c("base_loan_amount"), c("similar_loan_amount")) < dlit(LOAN_TOL))
            & (F.abs(c("base_dti") - c("similar_dti")) < dlit(DTI_TOL))
        )
    dist = F.when(
        (c("base_norm") > 0) & (c("similar_norm") > 0),
        dlit(1.0) - dot(c("base_vec"), c("similar_vec"), vector_dim) / (c("base_norm") * c("similar_norm")),
    )
    return cand.select("base_app_id", "similar_app_id", *block, dist.alias("financial_similarity_distance")).where(
        c("financial_similarity_distance") < dlit(max_distance)
    )
