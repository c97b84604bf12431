"""Final per-application assessment: risk score, explanation, confidence,
regulatory priority (D33-D36; T10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dlit, guarded_least, join_nonnull, label_map

# ---- fixed values of the audit -------------------------------------------------
RISK_CAP = 100.0
VIOLATION_WEIGHT, EVIDENCE_WEIGHT, OUTLIER_POINTS = 4, 8, 5
DISPARITY_POINTS = {"CLUSTER_RACIAL_DISPARITY": 8, "CLUSTER_ETHNIC_DISPARITY": 7, "CLUSTER_GENDER_DISPARITY": 6}
EXPLANATIONS = [
    ("R001_ai_violation", "AI-verified: Qualified applicant with similar approved profiles inappropriately denied"),
    ("R003_ai_violation", "AI-verified: Vector similarity shows racial discrimination in similar financial profiles"),
    ("R004_ai_violation", "AI-verified: Vector similarity shows gender discrimination in similar financial profiles"),
    ("R005_ai_violation", "AI-verified: Vector similarity shows ethnic discrimination in similar financial profiles"),
    ("R006_ai_violation", "AI cluster analysis: Anomalous denial in minority area detected"),
    ("R007_ai_violation", "AI pattern recognition: Outlier in minority lending cluster identified"),
    ("R008_ai_violation", "AI multi-dimensional analysis: Intersectional discrimination detected"),
]
OUTLIER_EXPLANATION = "AI clustering: Application is statistical outlier in embedding space"
DISPARITY_EXPLANATION = ("AI cluster disparity: ", " detected")
EXPLANATION_SEPARATOR = "; "
# ---------------------------------------------------------------------------------

ASSESSMENT_BASE = [
    "application_id", "lei", "state_code", "race_category", "ethnicity_category", "gender_category", "approved",
    "total_ai_violation_score", "ai_violation_severity", "ai_confidence_level",
    "R001_ai_violation", "R003_ai_violation", "R004_ai_violation", "R005_ai_violation",
    "R006_ai_violation", "R007_ai_violation", "R008_ai_violation",
]
STAT_COLUMNS = [
    "ai_enhanced_discrimination_evidence_score", "white_black_significant", "white_hispanic_significant",
    "male_female_significant", "black_disparate_impact", "hispanic_disparate_impact", "female_disparate_impact",
    "racial_ai_validation_strength", "gender_ai_validation_strength",
]
CLUSTER_TAIL = ["cluster_id", "is_cluster_outlier", "cluster_disparity_type", "distance_to_centroid"]


def risk_score():
    """``LEAST(100, 4*total + 8*evidence + outlier + disparity)``, NULL
    when the lender has no statistics (evidence NULL)."""
    c = F.col
    raw = (
        c("total_ai_violation_score") * VIOLATION_WEIGHT
        + c("ai_enhanced_discrimination_evidence_score") * EVIDENCE_WEIGHT
        + F.when(c("is_cluster_outlier"), F.lit(OUTLIER_POINTS)).otherwise(F.lit(0))
        + label_map(c("cluster_disparity_type"), DISPARITY_POINTS, 0)
    )
    return guarded_least(RISK_CAP, raw)


def explanation():
    """The sentences of every rule that fired, joined by '; '."""
    c = F.col
    parts = [F.when(c(col) > 0, F.lit(text)) for col, text in EXPLANATIONS]
    parts.append(F.when(c("is_cluster_outlier"), F.lit(OUTLIER_EXPLANATION)))
    parts.append(
        F.when(
            c("cluster_disparity_type") != "NO_CLUSTER_DISPARITY",
            F.concat(F.lit(DISPARITY_EXPLANATION[0]), c("cluster_disparity_type"), F.lit(DISPARITY_EXPLANATION[1])),
        )
    )
    return join_nonnull(EXPLANATION_SEPARATOR, parts)


def final_confidence():
    """D35."""
    c = F.col
    level, ev, total = c("ai_confidence_level"), c("ai_enhanced_discrimination_evidence_score"), c("total_ai_violation_score")
    return (
        F.when((level == "HIGH_AI_CONFIDENCE") & (ev >= 6) & (total >= dlit(15)), "VERY_HIGH_CONFIDENCE")
        .when(level.isin("HIGH_AI_CONFIDENCE", "MEDIUM_AI_CONFIDENCE") & (ev >= 4) & (total >= dlit(8)), "HIGH_CONFIDENCE")
        .when((level != "NO_AI_EVIDENCE") & ((ev >= 2) | (total >= dlit(3))), "MEDIUM_CONFIDENCE")
        .when((total > dlit(0)) | (ev > 0), "LOW_CONFIDENCE")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )


def regulatory_priority():
    """D36 (on the already computed risk score; a NULL score is low risk)."""
    c = F.col
    risk, level = c("ai_enhanced_mln_risk_score"), c("ai_confidence_level")
    impact = c("black_disparate_impact") | c("hispanic_disparate_impact") | c("female_disparate_impact")
    significant = c("white_black_significant") | c("white_hispanic_significant") | c("male_female_significant")
    return (
        F.when((risk >= dlit(60)) & (level == "HIGH_AI_CONFIDENCE") & impact, "AI_IMMEDIATE_INVESTIGATION")
        .when((risk >= dlit(40)) & level.isin("HIGH_AI_CONFIDENCE", "MEDIUM_AI_CONFIDENCE") & significant, "AI_HIGH_PRIORITY")
        .when((risk >= dlit(20)) & c("ai_violation_severity").isin("AI_HIGH", "AI_CRITICAL"), "AI_MEDIUM_PRIORITY")
        .when(risk >= dlit(5), "AI_MONITORING_REQUIRED")
        .otherwise("AI_LOW_RISK")
    )


def final_assessment(violations: DataFrame, statistics: DataFrame) -> DataFrame:
    """Violations left-joined with their lender/state statistics.

    The statistics table has one row per lender/state; AQE broadcasts it when
    measured small and otherwise shuffles (splitting a hot lender's partition).
    """
    stats = statistics.select("lei", "state_code", *STAT_COLUMNS)
    joined = violations.select(*ASSESSMENT_BASE, *CLUSTER_TAIL).join(stats, ["lei", "state_code"], "left")
    integrated = joined.select(*ASSESSMENT_BASE, *STAT_COLUMNS, *CLUSTER_TAIL)
    scored = integrated.withColumn("ai_enhanced_mln_risk_score", risk_score())
    return scored.withColumns(
        {
            "ai_enhanced_explanation": explanation(),
            "final_confidence_assessment": final_confidence(),
            "ai_regulatory_priority": regulatory_priority(),
        }
    )
