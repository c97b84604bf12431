"""Embedding-grid clusters, centroid distances, outliers and cluster disparity.

A cluster is a cell of the grid ``round(v[i] * scale)`` over the first
``dims`` embedding coordinates, inside one block (lender/state), kept when it
holds at least ``min_size`` applications.

Plan: one aggregate per cell gives centroid, size and all demographic counts
(partial aggregation before the shuffle); the kept cells are stored once and joined
back on the cell key columns (never on a hash of them, which could collide). A second
aggregate gives mean and standard deviation of the centroid distances. Up to
``FEW_CELLS`` kept cells go to every task, so that no application is moved to meet
them; more are met by equi-joins under salted keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dlit, safe_divide, stable_hash64
from ..sources import sinks

# ---- fixed values of the audit -------------------------------------------------
GRID_SCALE = 5.0
GRID_DIMS = 3
#: Keys that the rows of one cell are dealt over.
SALTS = 16
#: Kept cells up to which their statistics go to every task.
FEW_CELLS = 200_000
MIN_CLUSTER_SIZE = 20
OUTLIER_SIGMAS = 2.0
RACIAL_GAP, ETHNIC_GAP, GENDER_GAP = 0.15, 0.15, 0.10
MIN_SHARE, MIN_GROUP_COUNT = 0.1, 10
CLUSTER_RACIAL = "CLUSTER_RACIAL_DISPARITY"
CLUSTER_ETHNIC = "CLUSTER_ETHNIC_DISPARITY"
CLUSTER_GENDER = "CLUSTER_GENDER_DISPARITY"
NO_CLUSTER_DISPARITY = "NO_CLUSTER_DISPARITY"
SIZE_BANDS = [((20, 100), "OPTIMAL_SIZE"), ((101, 500), "LARGE_CLUSTER")]
SIZE_DEFAULT = "VERY_LARGE_CLUSTER"
# ---------------------------------------------------------------------------------

CLUSTER_COLUMNS = [
    "application_id", "lei", "state_code", "race_category", "ethnicity_category", "gender_category", "approved",
    "cluster_id", "distance_to_centroid", "cluster_size", "cluster_approval_rate", "white_approval_rate",
    "black_approval_rate", "hispanic_approval_rate", "female_approval_rate", "white_percentage",
    "black_percentage", "hispanic_percentage", "female_percentage", "is_cluster_outlier",
    "cluster_disparity_type", "cluster_size_category",
]


def _q(i: int) -> str:
    return f"quantized_dim{i + 1}"


def lead_columns(vector_col: str = "profile_embedding", dims: int = GRID_DIMS, name: str | None = None) -> dict[str, Column]:
    """Scalar copies of a vector's length and first ``dims`` coordinates.

    Stored next to the vector, they let the grid read a few doubles per row
    instead of the whole array (parquet cannot prune array elements; a text
    embedding has hundreds of them). ``name``: what they are named after, if not the column."""
    v, name = F.col(vector_col), name or vector_col
    cols = {f"{name}_size": F.size(v)}
    cols.update({f"{name}_{i}": F.get(v, i) for i in range(dims)})
    return cols


def grid_cells(df: DataFrame, vector_col: str = "profile_embedding", dims: int = GRID_DIMS,
               scale: float = GRID_SCALE) -> DataFrame:
    """M7 step 1: quantised coordinates ``round(v[i]*scale)`` (0 past the end).

    Uses the scalar lead columns (:func:`lead_columns`) when the input has
    them, the array otherwise."""
    names = list(lead_columns(vector_col, dims))
    if all(n in df.columns for n in names):
        size, xs = F.col(names[0]), [F.col(n) for n in names[1:]]
        present = size.isNotNull()
    else:
        v = F.col(vector_col)
        size, xs = F.size(v), [F.get(v, i) for i in range(dims)]
        present = v.isNotNull()
    ok = present & F.col("lei").isNotNull() & F.col("state_code").isNotNull() & (size >= dims)
    quant = {
        _q(i): F.when(size > i, F.round(xs[i] * dlit(scale)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        for i in range(dims)
    }
    coords = {f"_x{i}": xs[i] for i in range(dims)}
    return df.where(ok).withColumns(quant).withColumns(coords)


def cluster_key(dims: int = GRID_DIMS) -> Column:
    parts = []
    for i in range(dims):
        parts += [F.col(_q(i)).cast("string"), F.lit("_")]
    return F.concat(*parts, F.col("lei"), F.lit("_"), F.col("state_code"))


def grid_clusters(
    embedded: DataFrame,
    *,
    vector_col: str = "profile_embedding",
    dims: int = GRID_DIMS,
    scale: float = GRID_SCALE,
    min_size: int = MIN_CLUSTER_SIZE,
    n_sigmas: float = OUTLIER_SIGMAS,
    block: Sequence[str] = ("lei", "state_code"),
) -> DataFrame:
    """M7-M9 + D14-D16: one row per application in a kept cell."""
    c = F.col
    cells = grid_cells(embedded, vector_col, dims, scale).select(
        "application_id", *block, "race_category", "ethnicity_category", "gender_category", "approved",
        *[_q(i) for i in range(dims)], *[f"_x{i}" for i in range(dims)],
    )
    cell_cols = list(block) + [_q(i) for i in range(dims)]

    white, black = c("race_category") == "White", c("race_category") == "Black"
    hisp, female = c("ethnicity_category") == "Hispanic", c("gender_category") == "Female"
    stats = (
        cells.groupBy(*cell_cols)
        .agg(
            *[F.avg(f"_x{i}").alias(f"_center{i}") for i in range(dims)],
            F.count(F.lit(1)).alias("cluster_size"),
            F.count_if(c("approved")).alias("_approved"),
            F.count_if(white).alias("white_count"),
            F.count_if(black).alias("black_count"),
            F.count_if(hisp).alias("hispanic_count"),
            F.count_if(female).alias("female_count"),
            F.count_if(c("approved") & white).alias("_white_approved"),
            F.count_if(c("approved") & black).alias("_black_approved"),
            F.count_if(c("approved") & hisp).alias("_hispanic_approved"),
            F.count_if(c("approved") & female).alias("_female_approved"),
        )
        .where(c("cluster_size") >= min_size)
        .withColumn("cluster_id", stable_hash64(cluster_key(dims)))  # once a cell, not once a row
    )
    # read by both joins, and its rows are counted
    stats = sinks.scratch_table(stats, "kept_cells")
    few = stats.count() <= FEW_CELLS
    # else a hot cell's rows meet its statistics under SALTS keys; the statistics, one row a
    # cell, are copied to all of them
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    if not few:
        cells = cells.withColumn("_salt", F.pmod(F.xxhash64("application_id"), F.lit(SALTS)).cast("int"))

    def meet(rows: DataFrame, per_cell: DataFrame) -> DataFrame:
        if few:
            return rows.join(F.broadcast(per_cell), cell_cols)
        # never a broadcast of all copies
        return rows.join(per_cell.select("*", salt).hint("merge"), [*cell_cols, "_salt"])

    assigned = meet(cells, stats).withColumns(
        {
            "distance_to_centroid": F.sqrt(
                sum((F.pow(c(f"_x{i}") - c(f"_center{i}"), dlit(2.0)) for i in range(1, dims)),
                    F.pow(c("_x0") - c("_center0"), dlit(2.0)))
            ),
        }
    )
    spread = assigned.groupBy(*cell_cols).agg(
        F.avg("distance_to_centroid").alias("_avg_dist"),
        F.stddev_samp("distance_to_centroid").alias("_std_dist"),
    )
    n = c("cluster_size")
    out = meet(assigned, spread).withColumns(
        {
            "cluster_approval_rate": safe_divide(c("_approved"), n),
            "white_percentage": safe_divide(c("white_count"), n),
            "black_percentage": safe_divide(c("black_count"), n),
            "hispanic_percentage": safe_divide(c("hispanic_count"), n),
            "female_percentage": safe_divide(c("female_count"), n),
            "white_approval_rate": safe_divide(c("_white_approved"), c("white_count")),
            "black_approval_rate": safe_divide(c("_black_approved"), c("black_count")),
            "hispanic_approval_rate": safe_divide(c("_hispanic_approved"), c("hispanic_count")),
            "female_approval_rate": safe_divide(c("_female_approved"), c("female_count")),
        }
    )
    out = out.withColumns(
        {
            "is_cluster_outlier": F.coalesce(
                c("distance_to_centroid") > c("_avg_dist") + dlit(n_sigmas) * c("_std_dist"), F.lit(False)
            ),
            "cluster_disparity_type": cluster_disparity(),
            "cluster_size_category": F.when(n.between(*SIZE_BANDS[0][0]), SIZE_BANDS[0][1])
            .when(n.between(*SIZE_BANDS[1][0]), SIZE_BANDS[1][1])
            .otherwise(SIZE_DEFAULT),
        }
    )
    return out.select(*CLUSTER_COLUMNS)


def cluster_disparity() -> Column:
    """First disparity that clears gap, share and count thresholds."""
    c = F.col

    def gap(rate: str, share: str, count: str, threshold: float) -> Column:
        return (
            (c("white_approval_rate") - c(rate) > dlit(threshold))
            & (c(share) >= dlit(MIN_SHARE))
            & (c("white_count") >= MIN_GROUP_COUNT) & (c(count) >= MIN_GROUP_COUNT)
        )

    return (
        F.when(gap("black_approval_rate", "black_percentage", "black_count", RACIAL_GAP), CLUSTER_RACIAL)
        .when(gap("hispanic_approval_rate", "hispanic_percentage", "hispanic_count", ETHNIC_GAP), CLUSTER_ETHNIC)
        .when(gap("female_approval_rate", "female_percentage", "female_count", GENDER_GAP), CLUSTER_GENDER)
        .otherwise(NO_CLUSTER_DISPARITY)
    )


def sigma_outliers(df: DataFrame, value: str, by: Sequence[str], n_sigmas: float = OUTLIER_SIGMAS,
                   out_col: str = "is_outlier") -> DataFrame:
    """M9 on its own: flag ``value > mean + n_sigmas * stddev`` within ``by``.

    Group statistics come from one aggregate joined back on ``by`` (a hot
    group is split by AQE), not from a window over the whole group.
    """
    c = F.col
    stats = df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"))
    return df.join(stats, list(by)).withColumn(
        out_col, F.coalesce(c(value) > c("_mean") + dlit(n_sigmas) * c("_std"), F.lit(False))
    ).drop("_mean", "_std")
