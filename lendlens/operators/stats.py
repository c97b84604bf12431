"""Lender/state statistics, two-proportion z-tests, disparate impact.

One partial/final aggregate per ``(lei, state_code)`` -- map-side combine
keeps a lender holding a third of all rows from landing in one task -- then
only column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import below, dlit, exceeds, ieee_divide, label_map, safe_divide

# ---- fixed values of the audit -------------------------------------------------
MIN_LENDER_APPS = 50
MIN_GROUP_APPS = 30
Z_CRITICAL = 1.96
FOUR_FIFTHS = 0.8
STRENGTH_BANDS = [(10, "STRONG_AI_VALIDATION"), (5, "MODERATE_AI_VALIDATION"), (1, "WEAK_AI_VALIDATION")]
STRENGTH_DEFAULT = "NO_AI_VALIDATION"
EVIDENCE_POINTS = {"STRONG_AI_VALIDATION": 4, "MODERATE_AI_VALIDATION": 3, "WEAK_AI_VALIDATION": 2}
EVIDENCE_POINTS_DEFAULT = 1
# ---------------------------------------------------------------------------------

# z-test forms: how the pooled proportion p and the variance term are built.
#   "sum_halves": p=(p1+p2)/2, q=(1-(p1+p2))/2  (the audit's White/Black, White/Hispanic)
#   "mean":       p=(p1+p2)/2, q=1-p              (the audit's Male/Female)
#   "weighted":   p=(x1+x2)/(n1+n2), q=1-p        (textbook pooled test)
Z_FORMS = ("sum_halves", "mean", "weighted")
PUBLISHED_FORMS = {"white_black": "sum_halves", "white_hispanic": "sum_halves", "male_female": "mean"}


def two_proportion_z(p1: Column, n1: Column, p2: Column, n2: Column, form: str = "mean",
                     min_n: int = MIN_GROUP_APPS) -> Column:
    """``|p1-p2| / sqrt(|p q (1/n1 + 1/n2)|)`` with IEEE division; NULL
    unless both groups have at least ``min_n`` applications."""
    if form not in Z_FORMS:
        raise ValueError(f"form must be one of {Z_FORMS}")
    s = p1 + p2
    if form == "sum_halves":
        pq = ieee_divide(s, dlit(2.0)) * ieee_divide(dlit(1.0) - s, dlit(2.0))
    elif form == "mean":
        pq = ieee_divide(s, dlit(2.0)) * (dlit(1.0) - ieee_divide(s, dlit(2.0)))
    else:
        p = ieee_divide(p1 * n1 + p2 * n2, n1 + n2)
        pq = p * (dlit(1.0) - p)
    z = ieee_divide(F.abs(p1 - p2), F.sqrt(F.abs(pq * (ieee_divide(dlit(1.0), n1) + ieee_divide(dlit(1.0), n2)))))
    return F.when((n1 >= min_n) & (n2 >= min_n), z)


def _rate(group: Column) -> Column:
    """Mean approval within ``group`` (NULL for rows outside it)."""
    return F.avg(F.when(group, F.when(F.col("approved"), dlit(1.0)).otherwise(dlit(0.0))))


FACT_COLUMNS = ("race_category", "ethnicity_category", "gender_category", "approved", "cluster_disparity_type",
                "has_race_pair", "has_gender_pair")


def lender_statistics(
    embedded: DataFrame,
    clusters: DataFrame | None = None,
    evidence: DataFrame | None = None,
    *,
    block: Sequence[str] = ("lei", "state_code"),
    min_apps: int = MIN_LENDER_APPS,
) -> DataFrame:
    """Counts and approval rates per block with at least ``min_apps`` rows.

    Either pass the applications with their clusters and pair evidence, or a
    single per-application table that already holds :data:`FACT_COLUMNS`
    (the stored rule-violation table with the pair flags carried), which
    saves two joins on the application id.

    ``COUNT(DISTINCT id) FILTER (has pair)`` is a ``count_if`` because ids are
    unique per row, which avoids a distinct aggregation.
    """
    c = F.col
    if clusters is None and evidence is None:
        joined = embedded.select(*block, *FACT_COLUMNS)
    else:
        apps = embedded.select("application_id", *block, "race_category", "ethnicity_category", "gender_category", "approved")
        joined = (
            apps.join(clusters.select("application_id", "cluster_disparity_type"), "application_id", "left")
            .join(evidence.select("application_id", "has_race_pair", "has_gender_pair"), "application_id", "left")
        )
    white, black, asian = (c("race_category") == v for v in ("White", "Black", "Asian"))
    hisp = c("ethnicity_category") == "Hispanic"
    female, male = c("gender_category") == "Female", c("gender_category") == "Male"
    return (
        joined.groupBy(*block)
        .agg(
            F.count(F.lit(1)).alias("total_applications"),
            F.avg(F.when(c("approved"), dlit(1.0)).otherwise(dlit(0.0))).alias("overall_approval_rate"),
            F.count_if(F.coalesce(c("has_race_pair"), F.lit(False))).alias("apps_with_racial_similar_pairs"),
            F.count_if(F.coalesce(c("has_gender_pair"), F.lit(False))).alias("apps_with_gender_similar_pairs"),
            _rate(white).alias("white_approval_rate"),
            _rate(black).alias("black_approval_rate"),
            _rate(asian).alias("asian_approval_rate"),
            _rate(hisp).alias("hispanic_approval_rate"),
            _rate(female).alias("female_approval_rate"),
            _rate(male).alias("male_approval_rate"),
            _rate(c("cluster_disparity_type") == "CLUSTER_RACIAL_DISPARITY").alias("cluster_racial_disparity_approval_rate"),
            _rate(c("cluster_disparity_type") == "CLUSTER_GENDER_DISPARITY").alias("cluster_gender_disparity_approval_rate"),
            F.count_if(white).alias("white_applications"),
            F.count_if(black).alias("black_applications"),
            F.count_if(asian).alias("asian_applications"),
            F.count_if(hisp).alias("hispanic_applications"),
            F.count_if(female).alias("female_applications"),
            F.count_if(male).alias("male_applications"),
        )
        .where(c("total_applications") >= min_apps)
    )


def validation_strength(count: Column) -> Column:
    """STRONG / MODERATE / WEAK / NO by number of applications with pairs."""
    expr = None
    for bound, label in STRENGTH_BANDS:
        expr = F.when(count >= bound, label) if expr is None else expr.when(count >= bound, label)
    return expr.otherwise(STRENGTH_DEFAULT)


def evidence_points(z: Column, ratio: Column, strength: Column) -> Column:
    """D32 term: both flags -> 4/3/2/1 by strength; one flag -> 1; none -> 0."""
    sig = exceeds(z, Z_CRITICAL, 0.0)
    di = below(ratio, FOUR_FIFTHS, 1.0)
    return (
        F.when(sig & di, label_map(strength, EVIDENCE_POINTS, EVIDENCE_POINTS_DEFAULT))
        .when(sig | di, F.lit(1))
        .otherwise(F.lit(0))
    )


def statistical_tests(stats: DataFrame, z_forms: dict[str, str] | None = None) -> DataFrame:
    """D28-D32 on :func:`lender_statistics` output."""
    forms = {**PUBLISHED_FORMS, **(z_forms or {})}
    c = F.col
    tested = stats.withColumns(
        {
            "white_black_z_score": two_proportion_z(c("white_approval_rate"), c("white_applications"), c("black_approval_rate"), c("black_applications"), forms["white_black"]),
            "white_hispanic_z_score": two_proportion_z(c("white_approval_rate"), c("white_applications"), c("hispanic_approval_rate"), c("hispanic_applications"), forms["white_hispanic"]),
            "male_female_z_score": two_proportion_z(c("male_approval_rate"), c("male_applications"), c("female_approval_rate"), c("female_applications"), forms["male_female"]),
            "black_white_ratio": safe_divide(c("black_approval_rate"), c("white_approval_rate")),
            "hispanic_white_ratio": safe_divide(c("hispanic_approval_rate"), c("white_approval_rate")),
            "female_male_ratio": safe_divide(c("female_approval_rate"), c("male_approval_rate")),
            "racial_ai_validation_strength": validation_strength(c("apps_with_racial_similar_pairs")),
            "gender_ai_validation_strength": validation_strength(c("apps_with_gender_similar_pairs")),
        }
    )
    return tested.withColumns(
        {
            "white_black_significant": exceeds(c("white_black_z_score"), Z_CRITICAL, 0.0),
            "white_hispanic_significant": exceeds(c("white_hispanic_z_score"), Z_CRITICAL, 0.0),
            "male_female_significant": exceeds(c("male_female_z_score"), Z_CRITICAL, 0.0),
            "black_disparate_impact": below(c("black_white_ratio"), FOUR_FIFTHS, 1.0),
            "hispanic_disparate_impact": below(c("hispanic_white_ratio"), FOUR_FIFTHS, 1.0),
            "female_disparate_impact": below(c("female_male_ratio"), FOUR_FIFTHS, 1.0),
            "ai_enhanced_discrimination_evidence_score": (
                evidence_points(c("white_black_z_score"), c("black_white_ratio"), c("racial_ai_validation_strength"))
                + evidence_points(c("white_hispanic_z_score"), c("hispanic_white_ratio"), c("racial_ai_validation_strength"))
                + evidence_points(c("male_female_z_score"), c("female_male_ratio"), c("gender_ai_validation_strength"))
            ),
        }
    )
