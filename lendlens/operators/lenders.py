"""Lender/state roll-up of the assessment: tiers and disparity flags (D37-D40; T11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dlit, label_map

# ---- fixed values of the audit -------------------------------------------------
MIN_LENDER_APPS = 50
STRENGTH_SCORES = {"STRONG_AI_VALIDATION": 3, "MODERATE_AI_VALIDATION": 2, "WEAK_AI_VALIDATION": 1}
TIERS = ["AI_TIER_1_CRITICAL", "AI_TIER_2_HIGH_RISK", "AI_TIER_3_ELEVATED_RISK", "AI_TIER_4_MONITORING", "AI_TIER_5_LOW_RISK"]
VERIFIED_GAP, POSSIBLE_GAP, VERIFIED_STRENGTH = 15, 10, 2
# ---------------------------------------------------------------------------------


def lender_aggregation(assessment: DataFrame, min_apps: int = MIN_LENDER_APPS) -> DataFrame:
    """22 aggregates per lender/state with at least ``min_apps`` rows."""
    c = F.col
    risk = c("ai_enhanced_mln_risk_score")
    sev, conf, prio = c("ai_violation_severity"), c("final_confidence_assessment"), c("ai_regulatory_priority")
    return (
        assessment.groupBy("lei", "state_code")
        .agg(
            F.count(F.lit(1)).alias("total_applications_analyzed"),
            F.avg(risk).alias("avg_ai_mln_risk_score"),
            F.max(risk).alias("max_ai_mln_risk_score"),
            F.count_if(sev == "AI_CRITICAL").alias("ai_critical_violations"),
            F.count_if(sev == "AI_HIGH").alias("ai_high_violations"),
            F.count_if(sev.isin("AI_CRITICAL", "AI_HIGH")).alias("serious_ai_violations"),
            F.count_if(conf == "VERY_HIGH_CONFIDENCE").alias("very_high_confidence_cases"),
            F.count_if(conf == "HIGH_CONFIDENCE").alias("high_confidence_cases"),
            F.count_if(conf.isin("VERY_HIGH_CONFIDENCE", "HIGH_CONFIDENCE")).alias("confident_cases"),
            F.count_if(prio == "AI_IMMEDIATE_INVESTIGATION").alias("ai_immediate_investigation_cases"),
            F.count_if(prio == "AI_HIGH_PRIORITY").alias("ai_high_priority_cases"),
            F.count_if(prio.isin("AI_IMMEDIATE_INVESTIGATION", "AI_HIGH_PRIORITY")).alias("priority_cases"),
            F.avg(F.when(c("race_category") == "Black", risk)).alias("avg_black_ai_risk_score"),
            F.avg(F.when(c("ethnicity_category") == "Hispanic", risk)).alias("avg_hispanic_ai_risk_score"),
            F.avg(F.when(c("gender_category") == "Female", risk)).alias("avg_female_ai_risk_score"),
            F.avg(F.when((c("race_category") == "White") & (c("gender_category") == "Male"), risk)).alias("avg_white_male_ai_risk_score"),
            F.avg("distance_to_centroid").alias("avg_cluster_distance"),
            F.count_if(c("is_cluster_outlier")).alias("cluster_outlier_count"),
            F.count_if(c("cluster_disparity_type") == "CLUSTER_RACIAL_DISPARITY").alias("cluster_racial_disparity_count"),
            F.count_if(c("cluster_disparity_type") == "CLUSTER_GENDER_DISPARITY").alias("cluster_gender_disparity_count"),
            F.avg(label_map(c("racial_ai_validation_strength"), STRENGTH_SCORES, 0)).alias("avg_racial_ai_validation_score"),
            F.avg(label_map(c("gender_ai_validation_strength"), STRENGTH_SCORES, 0)).alias("avg_gender_ai_validation_score"),
        )
        .where(c("total_applications_analyzed") >= min_apps)
    )


def risk_tier() -> Column:
    """D38."""
    c = F.col
    avg = c("avg_ai_mln_risk_score")
    return (
        F.when(
            (c("ai_immediate_investigation_cases") >= 5)
            | ((c("ai_critical_violations") >= 10) & (c("very_high_confidence_cases") >= 15))
            | ((avg >= dlit(50)) & (c("confident_cases") >= 20)),
            TIERS[0],
        )
        .when(
            (c("ai_high_priority_cases") >= 10)
            | ((c("serious_ai_violations") >= 25) & (avg >= dlit(30)))
            | ((c("cluster_racial_disparity_count") >= 5) & (c("avg_racial_ai_validation_score") >= dlit(2))),
            TIERS[1],
        )
        .when(
            (c("priority_cases") >= 5)
            | ((c("serious_ai_violations") >= 10) & (avg >= dlit(15)))
            | ((c("cluster_outlier_count") >= 20) & (c("avg_cluster_distance") >= dlit(1.5))),
            TIERS[2],
        )
        .when((c("serious_ai_violations") >= 5) | (avg >= dlit(5)) | (c("cluster_racial_disparity_count") >= 1), TIERS[3])
        .otherwise(TIERS[4])
    )


def disparity_flag(group_avg: str, strength_avg: str, name: str) -> Column:
    """group's mean risk above the White-male mean by 15 (with strength) / 10."""
    c = F.col

    def over(points: float) -> Column:
        return F.coalesce(c(group_avg), dlit(0)) > F.coalesce(c("avg_white_male_ai_risk_score"), dlit(0)) + dlit(points)

    return (
        F.when(over(VERIFIED_GAP) & (c(strength_avg) >= dlit(VERIFIED_STRENGTH)), f"AI_VERIFIED_{name}_DISPARITY")
        .when(over(POSSIBLE_GAP), f"AI_POSSIBLE_{name}_DISPARITY")
        .otherwise(f"NO_AI_{name}_DISPARITY")
    )


def redlining_flag() -> Column:
    """D40."""
    c = F.col
    n = c("cluster_racial_disparity_count")
    return (
        F.when((n >= 3) & (c("avg_racial_ai_validation_score") >= dlit(VERIFIED_STRENGTH)), "AI_VERIFIED_REDLINING_PATTERN")
        .when(n >= 1, "AI_POSSIBLE_REDLINING_PATTERN")
        .otherwise("NO_AI_REDLINING_PATTERN")
    )


def lender_risk_summary(assessment: DataFrame, min_apps: int = MIN_LENDER_APPS) -> DataFrame:
    """T11. Row order is not part of a table; use :func:`tier_order` on read."""
    return lender_aggregation(assessment, min_apps).withColumns(
        {
            "ai_lender_risk_tier": risk_tier(),
            "ai_black_disparity_flag": disparity_flag("avg_black_ai_risk_score", "avg_racial_ai_validation_score", "BLACK"),
            "ai_hispanic_disparity_flag": disparity_flag("avg_hispanic_ai_risk_score", "avg_racial_ai_validation_score", "HISPANIC"),
            "ai_gender_disparity_flag": disparity_flag("avg_female_ai_risk_score", "avg_gender_ai_validation_score", "GENDER"),
            "ai_redlining_flag": redlining_flag(),
        }
    )


def tier_order(df: DataFrame) -> DataFrame:
    """O1: tier 1..5 first, then mean risk descending."""
    rank = label_map(F.col("ai_lender_risk_tier"), {t: i + 1 for i, t in enumerate(TIERS[:4])}, 5)
    return df.orderBy(rank, F.desc_nulls_last("avg_ai_mln_risk_score"))
