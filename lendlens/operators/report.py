"""Compliance report, dashboard, export view and run summary (D43-D46; T14, T15, V1)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import dlit, join_nonnull, label_map
from .evaluate import HIGH_RISK_TIERS

# ---- fixed values of the audit -------------------------------------------------
SAMPLE_SIZE = 5
CONFIDENT = ("VERY_HIGH_CONFIDENCE", "HIGH_CONFIDENCE")
ACTIONS = {
    "AI_TIER_1_CRITICAL": "AI_IMMEDIATE_EXAMINATION_WITH_VECTOR_EVIDENCE",
    "AI_TIER_2_HIGH_RISK": "AI_ACCELERATED_EXAMINATION_WITH_CLUSTERING_EVIDENCE",
    "AI_TIER_3_ELEVATED_RISK": "AI_ENHANCED_MONITORING_WITH_EMBEDDING_ANALYSIS",
}
DEFAULT_ACTION = "AI_STANDARD_SUPERVISION"
VERIFIED_TYPES = [
    ("ai_black_disparity_flag", "AI-Verified Racial Discrimination (Black)"),
    ("ai_hispanic_disparity_flag", "AI-Verified Ethnic Discrimination (Hispanic)"),
    ("ai_gender_disparity_flag", "AI-Verified Gender Discrimination"),
    ("ai_redlining_flag", "AI-Verified Redlining Pattern"),
]
VALIDATION_BANDS = [(2.5, "STRONG"), (1.5, "MODERATE"), (0.5, "WEAK")]
LEGAL_ADVANTAGES = [
    ("vector_similarity_benefit", "Vector similarity provides concrete evidence of similar treatment disparities"),
    ("clustering_benefit", "Embedding clusters identify systemic discrimination patterns"),
    ("confidence_benefit", "AI confidence scores enhance statistical evidence reliability"),
    ("intersectional_benefit", "Multi-dimensional analysis captures intersectional discrimination"),
]
EXPORT_METADATA = [
    ("methodology", "AI-Enhanced Markov Logic Network"),
    ("ai_techniques", "Vector similarity + Embedding clusters + Statistical validation"),
    ("ai_models_used", "textembedding-gecko@003 + K-means clustering + Cosine similarity"),
]
SUMMARY_STATUS = "AI-ENHANCED MLN IMPLEMENTATION COMPLETE"
SUMMARY_CONFIRMATION = (
    "True Markov Logic Network enhanced with BigQuery AI vector embeddings, similarity search, and clustering"
)
SUMMARY_FORMAT = "Processed %d applications using AI-enhanced MLN with %d vector similarity pairs and %d embedding clusters"
# ---------------------------------------------------------------------------------

SAMPLE_FIELDS = [
    "application_id", "ai_enhanced_mln_risk_score", "ai_regulatory_priority", "final_confidence_assessment",
    "ai_enhanced_explanation", "race_category", "ethnicity_category", "gender_category", "approved",
    "cluster_id", "is_cluster_outlier", "distance_to_centroid",
]
REPORT_LENDER_COLUMNS = [
    "ai_lender_risk_tier", "avg_ai_mln_risk_score", "ai_immediate_investigation_cases", "ai_high_priority_cases",
    "very_high_confidence_cases", "ai_black_disparity_flag", "ai_hispanic_disparity_flag",
    "ai_gender_disparity_flag", "ai_redlining_flag", "avg_racial_ai_validation_score",
    "avg_gender_ai_validation_score",
]


def flagged_samples(assessment: DataFrame, summary: DataFrame, k: int = SAMPLE_SIZE) -> DataFrame:
    """The ``k`` highest-risk confident applications per tier-1/2 lender,
    one row each with ``sample_rank`` (ties broken by application id).

    ``row_number() <= k`` is planned as a partial top-k before the shuffle
    (WindowGroupLimit), so a hot lender never sends all its rows to one task.
    """
    c = F.col
    lenders = summary.where(c("ai_lender_risk_tier").isin(*HIGH_RISK_TIERS)).select("lei", "state_code")
    flagged = assessment.where(c("final_confidence_assessment").isin(*CONFIDENT)).join(lenders, ["lei", "state_code"])
    w = Window.partitionBy("lei", "state_code").orderBy(F.desc_nulls_last("ai_enhanced_mln_risk_score"), "application_id")
    return flagged.withColumn("sample_rank", F.row_number().over(w)).where(c("sample_rank") <= k).select(
        "lei", "state_code", "sample_rank", *SAMPLE_FIELDS
    )


def _validation_label(score: Column, kind: str) -> Column:
    expr = None
    for bound, label in VALIDATION_BANDS:
        cond = score >= dlit(bound)
        text = f"{label}_AI_{kind}_VALIDATION"
        expr = F.when(cond, text) if expr is None else expr.when(cond, text)
    return expr.otherwise(f"NO_AI_{kind}_VALIDATION")


def compliance_report(assessment: DataFrame, summary: DataFrame, k: int = SAMPLE_SIZE,
                      as_of: _dt.datetime | None = None, nested_samples: bool = True) -> DataFrame:
    """One row per tier-1/2 lender/state with at least one confident case."""
    c = F.col
    samples = flagged_samples(assessment, summary, k)
    packed = samples.groupBy("lei", "state_code").agg(
        F.array_sort(F.collect_list(F.struct("sample_rank", *SAMPLE_FIELDS))).alias("_samples")
    )
    base = packed.join(summary.select("lei", "state_code", *REPORT_LENDER_COLUMNS), ["lei", "state_code"])
    verified = join_nonnull(", ", [F.when(c(flag).startswith("AI_VERIFIED"), F.lit(text)) for flag, text in VERIFIED_TYPES])
    tier = c("ai_lender_risk_tier")
    racial_verified = c("ai_black_disparity_flag").startswith("AI_VERIFIED") | c("ai_hispanic_disparity_flag").startswith("AI_VERIFIED")
    enforcement = (
        F.when((tier == "AI_TIER_1_CRITICAL") & racial_verified
               & ((c("avg_racial_ai_validation_score") >= dlit(2.0)) | (c("avg_gender_ai_validation_score") >= dlit(2.0))),
               "VERY_HIGH_AI_ENFORCEMENT_RISK")
        .when((tier == "AI_TIER_1_CRITICAL") & (c("very_high_confidence_cases") >= 10), "HIGH_AI_ENFORCEMENT_RISK")
        .when(tier.isin(*HIGH_RISK_TIERS), "MODERATE_AI_ENFORCEMENT_RISK")
        .otherwise("LOW_AI_ENFORCEMENT_RISK")
    )
    cols = [
        c("lei").alias("lender_id"), "state_code", "ai_lender_risk_tier",
        (c("ai_immediate_investigation_cases") + c("ai_high_priority_cases")).alias("total_flagged_applications"),
        "avg_ai_mln_risk_score", "very_high_confidence_cases",
        label_map(tier, ACTIONS, DEFAULT_ACTION).alias("ai_recommended_regulatory_action"),
        verified.alias("ai_verified_discrimination_types"),
        _validation_label(c("avg_racial_ai_validation_score"), "RACIAL").alias("ai_racial_validation_strength"),
        _validation_label(c("avg_gender_ai_validation_score"), "GENDER").alias("ai_gender_validation_strength"),
    ]
    if nested_samples:
        cols.append(F.transform(c("_samples"), lambda s: F.struct(*[s[f].alias(f) for f in SAMPLE_FIELDS])).alias("sample_ai_flagged_applications"))
    else:
        cols.append(F.array_join(F.transform(c("_samples"), lambda s: s["application_id"]), ",").alias("sample_application_ids"))
    cols.append(enforcement.alias("ai_enforcement_risk_level"))
    if nested_samples:
        cols.append(F.struct(*[F.lit(v).alias(k_) for k_, v in LEGAL_ADVANTAGES]).alias("ai_legal_advantages"))
        cols.append(_timestamp(as_of).alias("ai_report_generated_timestamp"))
    return base.select(*cols)


def _timestamp(as_of: _dt.datetime | None) -> Column:
    return F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()


# ---- fixed values: dashboard rows ---------------------------------------------------
DASHBOARD_TITLE = "=== AI-ENHANCED MARKOV LOGIC NETWORK FAIR LENDING ANALYSIS ==="
DASHBOARD_STATIC_ROWS = [
    ("AI-MLN IMPLEMENTATION VERIFICATION", "Vector Similarity Rules Implemented", "TRUE", "First-order logic rules enhanced with vector similarity validation"),
    ("AI-MLN IMPLEMENTATION VERIFICATION", "Embedding Cluster Analysis", "TRUE", "AI-powered cluster anomaly detection for discrimination patterns"),
    ("AI-MLN IMPLEMENTATION VERIFICATION", "Multi-dimensional Intersectional Analysis", "TRUE", "AI embedding space analysis for complex discrimination detection"),
    ("=== AI-MLN TECHNOLOGY ADVANTAGES ===", None, None, "Advanced capabilities beyond traditional discrimination detection"),
    ("AI TECHNOLOGY BENEFITS", "Vector Similarity Evidence", "IMPLEMENTED", "Concrete mathematical proof of similar treatment disparities"),
    ("AI TECHNOLOGY BENEFITS", "Embedding Cluster Patterns", "IMPLEMENTED", "Systematic discrimination pattern identification through clustering"),
    ("AI TECHNOLOGY BENEFITS", "Multi-dimensional Analysis", "IMPLEMENTED", "Intersectional discrimination detection in high-dimensional space"),
    ("AI TECHNOLOGY BENEFITS", "Automated Anomaly Detection", "IMPLEMENTED", "AI-powered outlier identification for regulatory efficiency"),
    ("AI TECHNOLOGY BENEFITS", "Confidence-Weighted Evidence", "IMPLEMENTED", "AI confidence scoring enhances traditional statistical evidence"),
    ("=== SYSTEM DEPLOYMENT STATUS ===", None, None, "Production readiness and regulatory compliance verification"),
    ("DEPLOYMENT READINESS", "AI-Enhanced MLN Implementation", "COMPLETE", "True MLN with BigQuery AI vector similarity and clustering"),
    ("DEPLOYMENT READINESS", "Vector Index Performance", "OPTIMIZED", "Cosine similarity search with IVF indexing for sub-second response"),
    ("DEPLOYMENT READINESS", "Embedding Generation Scalability", "VERIFIED", "Handles millions of applications with text-embedding-gecko model"),
    ("DEPLOYMENT READINESS", "Regulatory Compliance", "AI-ENHANCED", "Explainable AI with vector similarity evidence for legal proceedings"),
]
DP, DD, SV, MP, RI = (
    "AI-ENHANCED DATA PROCESSING", "AI-ENHANCED DISCRIMINATION DETECTION", "AI-ENHANCED STATISTICAL VALIDATION",
    "AI-MLN MODEL PERFORMANCE", "AI-ENHANCED REGULATORY IMPACT",
)
DASHBOARD_METRICS = {
    "embedded_apps": (DP, "Total Applications with AI Embeddings", "Applications processed with vector embeddings and clustering"),
    "pairs": (DP, "Vector Similarity Pairs Identified", "High-similarity financial profile pairs for discrimination detection"),
    "clusters": (DP, "AI Embedding Clusters Created", "K-means clusters for pattern recognition and anomaly detection"),
    "critical": (DD, "AI-Critical Violations Detected", "Applications with severe AI-verified MLN constraint violations"),
    "tier1": (DD, "AI Tier 1 Critical Lenders", "Lenders requiring immediate regulatory attention with AI validation"),
    "very_high": (DD, "Vector-Verified Discrimination Cases", "High-confidence discrimination cases with vector similarity evidence"),
    "di_strong": (SV, "AI-Verified Disparate Impact Cases", "Statistically significant disparities with strong AI validation"),
    "accuracy": (MP, "AI-Enhanced Model Accuracy", "Accuracy on validation set with AI-verified discrimination patterns"),
    "f1": (MP, "AI-Enhanced F1-Score", "Balanced precision and recall with vector similarity validation"),
    "auc": (MP, "AI-Enhanced AUC Score", "Area under curve with embedding-based discrimination detection"),
    "exams": (RI, "AI-Immediate Examinations Recommended", "Lenders requiring immediate examination with vector similarity evidence"),
    "enforcement": (RI, "Very High AI Enforcement Risk Cases", "Cases with very high enforcement success probability using AI evidence"),
}
# ---------------------------------------------------------------------------------

DASHBOARD_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("section_header", "metric_name", "metric_value", "description")])


def _fmt(fmt: str, value: Column) -> Column:
    """FORMAT(fmt, value); NULL for a NULL value (``format_string`` would print one)."""
    return F.when(value.isNotNull(), F.format_string(fmt, value))


def _metric_rows(one_row: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Turn a one-row aggregate into dashboard rows (no union per metric)."""
    structs = [
        F.struct(
            F.lit(DASHBOARD_METRICS[key][0]).alias("section_header"),
            F.lit(DASHBOARD_METRICS[key][1]).alias("metric_name"),
            value.alias("metric_value"),
            F.lit(DASHBOARD_METRICS[key][2]).alias("description"),
        )
        for key, value in metrics.items()
    ]
    return one_row.select(F.inline(F.array(*structs)))


def dashboard(spark: SparkSession, *, embedded: DataFrame, pairs: DataFrame, clusters: DataFrame,
              assessment: DataFrame, summary: DataFrame, statistics: DataFrame, metrics: DataFrame,
              report: DataFrame) -> DataFrame:
    """One aggregate per source table, turned into rows and unioned with
    the static rows (27 rows)."""
    c = F.col
    parts = [
        _metric_rows(embedded.agg(F.count(F.lit(1)).alias("n")), {"embedded_apps": _fmt("%d", c("n"))}),
        _metric_rows(pairs.agg(F.count(F.lit(1)).alias("n")), {"pairs": _fmt("%d", c("n"))}),
        _metric_rows(clusters.where(c("cluster_id").isNotNull()).agg(F.count_distinct("cluster_id").alias("n")), {"clusters": _fmt("%d", c("n"))}),
        _metric_rows(
            assessment.agg(
                F.count_if(c("ai_violation_severity") == "AI_CRITICAL").alias("crit"),
                F.count_if(c("final_confidence_assessment") == "VERY_HIGH_CONFIDENCE").alias("vh"),
            ),
            {"critical": _fmt("%d", c("crit")), "very_high": _fmt("%d", c("vh"))},
        ),
        _metric_rows(summary.agg(F.count_if(c("ai_lender_risk_tier") == "AI_TIER_1_CRITICAL").alias("n")), {"tier1": _fmt("%d", c("n"))}),
        _metric_rows(
            statistics.agg(F.count_if(c("black_disparate_impact") & (c("racial_ai_validation_strength") == "STRONG_AI_VALIDATION")).alias("n")),
            {"di_strong": _fmt("%d", c("n"))},
        ),
        _metric_rows(
            metrics,
            {
                "accuracy": _fmt("%.1f%%", c("ai_accuracy") * dlit(100)),
                "f1": _fmt("%.3f", c("ai_f1_score")),
                "auc": _fmt("%.3f", c("ai_auc_approximation")),
            },
        ),
        _metric_rows(
            report.agg(
                F.count_if(c("ai_recommended_regulatory_action") == "AI_IMMEDIATE_EXAMINATION_WITH_VECTOR_EVIDENCE").alias("ex"),
                F.count_if(c("ai_enforcement_risk_level") == "VERY_HIGH_AI_ENFORCEMENT_RISK").alias("en"),
            ),
            {"exams": _fmt("%d", c("ex")), "enforcement": _fmt("%d", c("en"))},
        ),
    ]
    static = spark.createDataFrame([(DASHBOARD_TITLE, None, None, None)] + DASHBOARD_STATIC_ROWS, DASHBOARD_SCHEMA)
    out = static
    for p in parts:
        out = out.unionByName(p)
    return out


def export_view(assessment: DataFrame, as_of: _dt.datetime | None = None, with_metadata: bool = True) -> DataFrame:
    """V1: nested export of every application with a positive risk score.

    The lender statistics the export shows are already on each assessment row
    (left-joined on lender/state when it was built), so no second join runs.
    """
    c = F.col
    joined = assessment.where(c("ai_enhanced_mln_risk_score") > dlit(0))
    cols = [
        "application_id", c("lei").alias("lender"), "state_code",
        F.struct("race_category", "ethnicity_category", "gender_category", "approved").alias("demographic_profile"),
        F.struct(
            c("R001_ai_violation").alias("ai_business_logic_violation"),
            c("R003_ai_violation").alias("ai_vector_racial_discrimination"),
            c("R004_ai_violation").alias("ai_vector_gender_discrimination"),
            c("R005_ai_violation").alias("ai_vector_ethnic_discrimination"),
            c("R006_ai_violation").alias("ai_cluster_minority_area_violation"),
            c("R007_ai_violation").alias("ai_cluster_outlier_violation"),
            c("R008_ai_violation").alias("ai_intersectional_violation"),
            c("total_ai_violation_score").alias("total_ai_weighted_violations"),
        ).alias("ai_mln_violations"),
        F.struct(
            "ai_confidence_level", "is_cluster_outlier", "cluster_disparity_type", "distance_to_centroid",
            "racial_ai_validation_strength", "gender_ai_validation_strength", "ai_enhanced_discrimination_evidence_score",
        ).alias("ai_validation_evidence"),
        "ai_enhanced_mln_risk_score", "ai_regulatory_priority", "final_confidence_assessment", "ai_enhanced_explanation",
        F.struct(
            "white_black_significant", "white_hispanic_significant", "male_female_significant",
            "black_disparate_impact", "hispanic_disparate_impact", "female_disparate_impact",
        ).alias("statistical_context"),
    ]
    if with_metadata:
        cols.append(
            F.struct(*[F.lit(v).alias(k) for k, v in EXPORT_METADATA], _timestamp(as_of).alias("processing_timestamp")).alias("ai_metadata")
        )
    return joined.select(*cols)


def run_summary(assessment: DataFrame, pairs: DataFrame, clusters: DataFrame,
                as_of: _dt.datetime | None = None, with_timestamp: bool = True) -> DataFrame:
    """One status row; the two other counts are scalar subqueries."""
    n_pairs = pairs.select(F.count(F.lit(1))).scalar()
    n_clusters = clusters.where(F.col("cluster_id").isNotNull()).select(F.count_distinct("cluster_id")).scalar()
    one = assessment.agg(F.count(F.lit(1)).alias("_n"))
    cols = [
        F.lit(SUMMARY_STATUS).alias("status"),
        F.lit(SUMMARY_CONFIRMATION).alias("confirmation"),
        F.format_string(SUMMARY_FORMAT, F.col("_n"), n_pairs, n_clusters).alias("ai_summary"),
    ]
    if with_timestamp:
        cols.append(_timestamp(as_of).alias("completion_timestamp"))
    return one.select(*cols)
