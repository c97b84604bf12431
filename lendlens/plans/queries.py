"""Registered queries: one per audit operator, each with its SQL oracle.

Every query reads the test tables of ``sf_dir`` through the adapter and runs
the audit stages it needs over the whole tables. Both engines project the
same explicit column list; DOUBLE columns are rounded to 9 decimals on both
sides so that summation order (which differs between engines) cannot change
the compared values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import round_doubles
from ..operators import assess, clusters, embed, pairs, report, rules, stats
from . import oracle as O
from . import oracle_values as V
from .pipeline import AuditPipeline, stages_needed, stages_to_store

ROUND_DIGITS = 9


@dataclass
class Query:
    name: str
    build: Callable[[AuditPipeline], DataFrame]
    columns: list[str] | None = None
    sql_from: str | None = None  # SQL body after SELECT <columns>; None: no oracle
    needs: list[str] = field(default_factory=list)
    sql_columns: list[str] | None = None  # SQL expressions when they differ from names


# Stages each registered query reads (see pipeline.STAGE_INPUTS).
QUERY_STAGES: dict[str, tuple[str, ...]] = {
    "scan_clean_applications": ("cleaned",), "feature_bands": ("features",), "amortized_dti": ("features",),
    "profile_text": ("profiles",), "financial_text": ("profiles",), "hash_embedding": ("profiles",),
    "embedding_assembly": ("embedded",), "cosine_distance_pairs": ("financial", "financial"), "similar_pairs": ("pairs",),
    "text_embedding_assembly": ("profiles",), "text_similar_pairs": ("text_embedded", "text_embedded"),
    "similar_pairs_both_directions": ("embedded", "embedded"), "rule_catalogue": ("violations",),
    "csv_applications": (), "csv_rejects": (), "stable_ids": (), "report_nested_samples": ("report",), "pair_evidence": ("evidence",), "grid_clusters": ("clusters",),
    "centroid_distance": ("clusters",), "sigma_outliers": ("clusters",), "cluster_disparity": ("clusters",),
    "rule_violations": ("violations",), "lender_stats": ("lender_stats",), "two_proportion_z": ("lender_stats",),
    "disparate_impact": ("statistics",), "evidence_score": ("statistics",), "statistical_analysis": ("statistics",),
    "final_assessment": ("assessment",), "explanations": ("assessment",), "lender_risk_summary": ("summary",),
    "validation": ("validation",), "performance_metrics": ("metrics",),
    "top5_flagged_per_lender": ("assessment", "summary"), "compliance_report": ("report",),
    "dashboard": ("dashboard",), "final_summary": ("run_summary",), "export_nested": ("export",),
    "layered_rules": ("layered_violations",), "roc_area": ("roc",),
    "knn_exact": (), "knn_ivf": (), "knn_ivf_all_cells": (), "knn_pq": (), "kmeans_assign": ("embedded",),
}


def _pipe(spark: SparkSession, sf_dir: str, name: str | None = None) -> AuditPipeline:
    """A fresh pipeline per query. The stages that this query reads more than
    once are stored once in a new folder under ``spark.checkpoint.dir``;
    nothing is shared between calls, so every query does all of its upstream
    work itself."""
    if name not in QUERY_STAGES:
        return AuditPipeline(spark, sf_dir, materialize=True)
    stages = QUERY_STAGES[name]
    return AuditPipeline(spark, sf_dir, materialize=True, store=stages_to_store(stages), needed=stages_needed(stages))


REGISTRY: dict[str, Query] = {}


def register(q: Query) -> None:
    REGISTRY[q.name] = q


# --- column lists ----------------------------------------------------------------
CLEAN_COLUMNS = [
    "application_id", "lei", "activity_year", "state_code", "county_code", "census_tract", "applicant_ethnicity_1",
    "applicant_race_1", "applicant_sex", "applicant_age", "income", "loan_amount", "rate_spread",
    "debt_to_income_ratio", "loan_type", "loan_purpose", "occupancy_type", "property_type",
    "derived_loan_product_type", "lien_status", "population", "minority_population_percent",
    "ffiec_median_family_income", "tract_to_msa_income_percentage", "action_taken", "denial_reason_1",
    "denial_reason_2", "denial_reason_3",
]
BAND_COLUMNS = ["application_id", "race_category", "ethnicity_category", "gender_category", "income_category",
                "area_minority_concentration", "relative_area_income", "approved"]
DTI_COLUMNS = ["application_id", "income", "loan_amount", "rate_spread", "calculated_dti_ratio"]
ASSEMBLY_COLUMNS = ["application_id", "lei", "state_code", "race_category", "ethnicity_category", "gender_category",
                    "approved", "income", "loan_amount", "calculated_dti_ratio", "rate_spread_adj",
                    "profile_dims", "p0", "p1", "p2", "f0", "f1", "f2", "f3"]
EVIDENCE_COLUMNS = ["application_id", "r001_neighbour", "r003_pairs", "r004_pairs", "r005_pairs", "min_distance",
                    "has_race_pair", "has_gender_pair"]
DISPARITY_COLUMNS = ["cluster_id", "lei", "state_code", "cluster_size", "cluster_approval_rate", "white_approval_rate",
                     "black_approval_rate", "hispanic_approval_rate", "female_approval_rate", "white_percentage",
                     "black_percentage", "hispanic_percentage", "female_percentage", "cluster_disparity_type",
                     "cluster_size_category"]
VIOLATION_COLUMNS = rules.VIOLATION_BASE + [f"R00{i}_ai_violation" for i in (1, 3, 4, 5, 6, 7, 8)] + [
    "total_ai_violation_score", "ai_confidence_level", "ai_violation_severity"]
LENDER_STAT_COLUMNS = [
    "lei", "state_code", "total_applications", "overall_approval_rate", "apps_with_racial_similar_pairs",
    "apps_with_gender_similar_pairs", "white_approval_rate", "black_approval_rate", "asian_approval_rate",
    "hispanic_approval_rate", "female_approval_rate", "male_approval_rate", "cluster_racial_disparity_approval_rate",
    "cluster_gender_disparity_approval_rate", "white_applications", "black_applications", "asian_applications",
    "hispanic_applications", "female_applications", "male_applications",
]
TEST_COLUMNS = ["white_black_z_score", "white_hispanic_z_score", "male_female_z_score", "black_white_ratio",
                "hispanic_white_ratio", "female_male_ratio", "racial_ai_validation_strength",
                "gender_ai_validation_strength"]
FLAG_COLUMNS = ["white_black_significant", "white_hispanic_significant", "male_female_significant",
                "black_disparate_impact", "hispanic_disparate_impact", "female_disparate_impact",
                "ai_enhanced_discrimination_evidence_score"]
STATISTICS_COLUMNS = LENDER_STAT_COLUMNS + TEST_COLUMNS + FLAG_COLUMNS
ASSESSMENT_COLUMNS = assess.ASSESSMENT_BASE + assess.STAT_COLUMNS + assess.CLUSTER_TAIL + [
    "ai_enhanced_mln_risk_score", "ai_enhanced_explanation", "final_confidence_assessment", "ai_regulatory_priority"]
SUMMARY_AGG_COLUMNS = [
    "lei", "state_code", "total_applications_analyzed", "avg_ai_mln_risk_score", "max_ai_mln_risk_score",
    "ai_critical_violations", "ai_high_violations", "serious_ai_violations", "very_high_confidence_cases",
    "high_confidence_cases", "confident_cases", "ai_immediate_investigation_cases", "ai_high_priority_cases",
    "priority_cases", "avg_black_ai_risk_score", "avg_hispanic_ai_risk_score", "avg_female_ai_risk_score",
    "avg_white_male_ai_risk_score", "avg_cluster_distance", "cluster_outlier_count", "cluster_racial_disparity_count",
    "cluster_gender_disparity_count", "avg_racial_ai_validation_score", "avg_gender_ai_validation_score",
]
SUMMARY_COLUMNS = SUMMARY_AGG_COLUMNS + ["ai_lender_risk_tier", "ai_black_disparity_flag", "ai_hispanic_disparity_flag",
                                         "ai_gender_disparity_flag", "ai_redlining_flag"]
VALIDATION_COLUMNS = ["lei", "state_code", "ai_lender_risk_tier", "avg_ai_mln_risk_score", "priority_cases",
                      "confident_cases", "avg_racial_ai_validation_score", "avg_gender_ai_validation_score",
                      "ai_verified_discriminatory_lender", "ai_mln_high_risk_prediction", "ai_classification_result"]
METRIC_COLUMNS = ["ai_true_positives", "ai_false_positives", "ai_true_negatives", "ai_false_negatives",
                  "total_lenders_evaluated", "ai_recall_sensitivity", "ai_precision", "ai_specificity", "ai_accuracy",
                  "ai_f1_score", "ai_auc_approximation", "ai_enhancement_benefit"]
SAMPLE_COLUMNS = ["lei", "state_code", "sample_rank"] + report.SAMPLE_FIELDS
REPORT_COLUMNS = ["lender_id", "state_code", "ai_lender_risk_tier", "total_flagged_applications", "avg_ai_mln_risk_score",
                  "very_high_confidence_cases", "ai_recommended_regulatory_action", "ai_verified_discrimination_types",
                  "ai_racial_validation_strength", "ai_gender_validation_strength", "sample_application_ids",
                  "ai_enforcement_risk_level"]
DASHBOARD_COLUMNS = ["section_header", "metric_name", "metric_value", "description"]
EXPORT_COLUMNS = [
    "application_id", "lender", "state_code", "race_category", "ethnicity_category", "gender_category", "approved",
    "ai_business_logic_violation", "ai_vector_racial_discrimination", "ai_vector_gender_discrimination",
    "ai_vector_ethnic_discrimination", "ai_cluster_minority_area_violation", "ai_cluster_outlier_violation",
    "ai_intersectional_violation", "total_ai_weighted_violations", "ai_confidence_level", "is_cluster_outlier",
    "cluster_disparity_type", "distance_to_centroid", "racial_ai_validation_strength", "gender_ai_validation_strength",
    "ai_enhanced_discrimination_evidence_score", "ai_enhanced_mln_risk_score", "ai_regulatory_priority",
    "final_confidence_assessment", "ai_enhanced_explanation", "white_black_significant", "white_hispanic_significant",
    "male_female_significant", "black_disparate_impact", "hispanic_disparate_impact", "female_disparate_impact",
]

# DOUBLE-typed output columns (rounded in the SQL twin; Spark rounds by schema).
DOUBLE_COLUMNS = set(
    """income loan_amount rate_spread calculated_dti_ratio minority_population_percent ffiec_median_family_income
    tract_to_msa_income_percentage rate_spread_adj p0 p1 p2 f0 f1 f2 f3 value base_income base_loan_amount base_dti
    similar_income similar_loan_amount similar_dti financial_similarity_distance income_diff_ratio
    loan_amount_diff_ratio dti_abs_diff distance_to_centroid cluster_approval_rate white_approval_rate
    black_approval_rate hispanic_approval_rate female_approval_rate white_percentage black_percentage
    hispanic_percentage female_percentage min_distance R001_ai_violation R003_ai_violation R004_ai_violation
    R005_ai_violation R006_ai_violation R007_ai_violation R008_ai_violation total_ai_violation_score
    overall_approval_rate asian_approval_rate male_approval_rate cluster_racial_disparity_approval_rate
    cluster_gender_disparity_approval_rate white_black_z_score white_hispanic_z_score male_female_z_score
    white_black_z_weighted white_hispanic_z_weighted male_female_z_weighted black_white_ratio hispanic_white_ratio
    female_male_ratio ai_enhanced_mln_risk_score avg_ai_mln_risk_score max_ai_mln_risk_score avg_black_ai_risk_score
    avg_hispanic_ai_risk_score avg_female_ai_risk_score avg_white_male_ai_risk_score avg_cluster_distance
    avg_racial_ai_validation_score avg_gender_ai_validation_score ai_recall_sensitivity ai_precision ai_specificity
    ai_accuracy ai_f1_score ai_auc_approximation ai_business_logic_violation ai_vector_racial_discrimination
    ai_vector_gender_discrimination ai_vector_ethnic_discrimination ai_cluster_minority_area_violation
    ai_cluster_outlier_violation ai_intersectional_violation total_ai_weighted_violations distance cosine_distance
    R002_ai_violation R009_ai_violation roc_area balanced_accuracy""".split()
)


def _sel(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols)


# --- ingest ----------------------------------------------------------------------
register(Query("scan_clean_applications", lambda p: _sel(p.cleaned, CLEAN_COLUMNS), CLEAN_COLUMNS, "cleaned", ["cleaned"]))


def _csv(p: AuditPipeline) -> DataFrame:
    """The raw applications written as CSV files, scanned again and cleaned: the CSV input path."""
    from ..operators.features import clean_applications
    from ..sources.raw import RAW_COLUMNS, read_raw_csv

    return clean_applications(read_raw_csv(p.spark, p.store_csv(p.raw.select(*RAW_COLUMNS))), hashed_key=True)


_CSV_COLUMNS = [c for c in CLEAN_COLUMNS if c != "application_id"]
register(Query("csv_applications", _csv, _CSV_COLUMNS, "cleaned", ["cleaned"]))


_FIRST_LOAD = "source_key % 3 <> 0"  # the rows whose files arrive first
STABLE_COLUMNS = [*CLEAN_COLUMNS, "first_load"]


def _stable_ids(p: AuditPipeline) -> DataFrame:
    """Two loads of CSV files: two thirds of the applications first, then those files and the others. The result is
    the second load, with the ids that the first one gave."""
    from ..operators.features import clean_rows
    from ..operators.register import load_applications
    from ..sources.raw import RAW_COLUMNS, SOURCE_KEY, read_raw_csv

    first = p.store_csv(p.raw.where(_FIRST_LOAD).select(*RAW_COLUMNS), "csv_first")
    added = p.store_csv(p.raw.where(f"NOT ({_FIRST_LOAD})").select(*RAW_COLUMNS), "csv_added")
    for files in ([first], [first, added]):
        rows = clean_rows(read_raw_csv(p.spark, files)).drop(SOURCE_KEY)
        loaded = load_applications(rows, p.stage_path("id_register"))
    return loaded


register(Query("stable_ids", _stable_ids, STABLE_COLUMNS, "stable_ids", ["stable_ids"]))


def _csv_rejects(p: AuditPipeline) -> DataFrame:
    """Counts by reason of a CSV scan with planted faults: by order key modulo 50, rows cut short (7), with a field
    too many (21), with text for the loan amount (13) or for the action (33)."""
    from ..sources.raw import RAW_COLUMNS, SOURCE_KEY, reject_counts, scan_raw_csv

    def fault(n: int):
        return F.col(SOURCE_KEY) % 50 == n

    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RAW_COLUMNS]
    cells[RAW_COLUMNS.index("loan_amount")] = F.when(fault(13), "twelve").otherwise(cells[RAW_COLUMNS.index("loan_amount")])
    cells[RAW_COLUMNS.index("action_taken")] = F.when(fault(33), "x1").otherwise(cells[RAW_COLUMNS.index("action_taken")])
    whole = F.concat_ws(",", *cells)
    line = F.when(fault(7), F.concat_ws(",", *cells[:-5])).when(fault(21), F.concat(whole, F.lit(",9"))).otherwise(whole)
    path = p.store_lines(p.raw.select(line.alias("value")))
    return reject_counts(*scan_raw_csv(p.spark, path, header=False))


register(Query("csv_rejects", _csv_rejects, ["reason", "n_rows"], """(
  SELECT CASE WHEN source_key % 50 IN (7, 21) THEN 'columns' WHEN source_key % 50 IN (13, 33) THEN 'value'
    ELSE 'accepted' END AS reason, count(*) AS n_rows FROM raw GROUP BY 1) x""", ["raw"]))
register(Query("feature_bands", lambda p: _sel(p.features, BAND_COLUMNS), BAND_COLUMNS, "features", ["features"]))
register(Query("amortized_dti", lambda p: _sel(p.features, DTI_COLUMNS), DTI_COLUMNS, "features", ["features"]))
register(Query("profile_text", lambda p: _sel(p.profiles, ["application_id", "profile_text"]),
               ["application_id", "profile_text"], "profiles", ["profiles"]))


def _financial_text(p: AuditPipeline) -> DataFrame:
    from ..operators.features import financial_texts
    return financial_texts(p.profiles)


register(Query(
    "financial_text", _financial_text, ["application_id", "financial_text"],
    "profiles WHERE income IS NOT NULL AND loan_amount IS NOT NULL AND calculated_dti_ratio IS NOT NULL "
    "AND rate_spread_adj IS NOT NULL", ["profiles"], ["application_id", f"{O.FINANCIAL_TEXT} AS financial_text"],
))


def _hash_embedding(p: AuditPipeline) -> DataFrame:
    return embed.hash_embedding_sparse(p.profiles, "application_id", "profile_text", dim=64, unique_ids=True)


_HASH_SQL_FROM = """(
  SELECT application_id, unnest(range(64)) AS slot, unnest(vec) AS value FROM (
    SELECT application_id,
      CASE WHEN norm > 0 THEN list_transform(counts, lambda x: x / norm) ELSE counts END AS vec FROM (
      SELECT application_id, counts, sqrt(list_sum(list_transform(counts, lambda x: x * x))) AS norm FROM (
        SELECT application_id,
          list_transform(range(64), lambda i: coalesce(list_sum(list_transform(hashed,
              lambda h: CASE WHEN h.slot = i THEN h.sign ELSE CAST(0 AS DOUBLE) END)), CAST(0 AS DOUBLE))) AS counts
        FROM (
          SELECT application_id,
            list_transform(list_filter(regexp_split_to_array(lower(profile_text), '[^a-z0-9]+'), lambda t: length(t) > 0),
              lambda t: {'slot': ('0x' || substr(md5(t), 1, 8))::BIGINT % 64,
                    'sign': CASE WHEN ('0x' || substr(md5(t), 9, 1))::BIGINT % 2 = 0
                                 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END}) AS hashed
          FROM profiles) a) b) c) d) e
WHERE value <> 0"""
register(Query("hash_embedding", _hash_embedding, ["application_id", "slot", "value"], _HASH_SQL_FROM, ["profiles"],
               ["application_id", "CAST(slot AS INTEGER) AS slot", "value"]))


def _assembly(p: AuditPipeline) -> DataFrame:
    e = p.embedded
    return e.select(
        *ASSEMBLY_COLUMNS[:11], F.size("profile_embedding").alias("profile_dims"),
        *[F.get("profile_embedding", i).alias(f"p{i}") for i in range(3)],
        *[F.get("financial_embedding", i).alias(f"f{i}") for i in range(4)],
    )


register(Query("embedding_assembly", _assembly, ASSEMBLY_COLUMNS, "embedded", ["embedded"],
               ASSEMBLY_COLUMNS[:11] + ["CAST(len(profile_embedding) AS INTEGER) AS profile_dims"]
               + [f"profile_embedding[{i + 1}] AS p{i}" for i in range(3)]
               + [f"financial_embedding[{i + 1}] AS f{i}" for i in range(4)]))



def _text_assembly(p: AuditPipeline) -> DataFrame:
    """Both text embeddings, re-assembled per application, as rows of their non-zero numbers."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_embedding").alias("v")) for k in ("profile", "financial")])
    rows = embed.embed_applications(p.profiles).select("application_id", F.explode(kinds).alias("e"))
    return rows.select("application_id", "e.kind", F.posexplode("e.v").alias("slot", "value")).where("value <> 0")


register(Query("text_embedding_assembly", _text_assembly, ["application_id", "kind", "slot", "value"],
               "(SELECT application_id, kind, unnest(range(64)) AS slot, unnest(v) AS value FROM "
               "(SELECT application_id, 'profile' AS kind, profile_embedding AS v FROM text_embedded UNION ALL "
               "SELECT application_id, 'financial', financial_embedding FROM text_embedded WHERE financial_embedding IS NOT NULL)) "
               "WHERE value <> 0", ["text_embedded"], ["application_id", "kind", "CAST(slot AS INTEGER) AS slot", "value"]))
register(Query("text_similar_pairs",
               lambda p: pairs.similar_pairs(p.text_embedded, max_distance=O.TEXT_DISTANCE, vector_dim=64),
               pairs.PAIR_COLUMNS, "text_pairs", ["text_pairs"]))

# --- pairs -------------------------------------------------------------------------
_COS = ["base_app_id", "similar_app_id", "lei", "state_code", "financial_similarity_distance"]
register(Query("cosine_distance_pairs",
               lambda p: _sel(pairs.cosine_distance_pairs(p.financial, vector_dim=p.financial_dim), _COS), _COS,
               "band_pairs WHERE financial_similarity_distance < CAST(0.05 AS DOUBLE) "
               "AND abs(base_income - similar_income) / greatest(base_income, similar_income) < CAST(0.1 AS DOUBLE) "
               "AND abs(base_loan_amount - similar_loan_amount) / greatest(base_loan_amount, similar_loan_amount) "
               "< CAST(0.1 AS DOUBLE) AND abs(base_dti - similar_dti) < CAST(0.05 AS DOUBLE)", ["band_pairs"]))
register(Query("similar_pairs", lambda p: p.pairs, pairs.PAIR_COLUMNS, "pairs", ["pairs"]))


def _evidence(p: AuditPipeline) -> DataFrame:
    return p.evidence.select(
        "application_id", F.col("_pair_R001").alias("r001_neighbour"), F.col("_pair_R003").alias("r003_pairs"),
        F.col("_pair_R004").alias("r004_pairs"), F.col("_pair_R005").alias("r005_pairs"),
        "min_distance", "has_race_pair", "has_gender_pair",
    )


register(Query("pair_evidence", _evidence, EVIDENCE_COLUMNS, "evidence", ["evidence"],
               ["application_id", "_pair_R001 AS r001_neighbour", "_pair_R003 AS r003_pairs",
                "_pair_R004 AS r004_pairs", "_pair_R005 AS r005_pairs", "min_distance", "has_race_pair",
                "has_gender_pair"]))

register(Query("similar_pairs_both_directions",
               lambda p: pairs.similar_pairs(p.embedded, vector_dim=p.financial_dim, both_directions=True),
               pairs.PAIR_COLUMNS, "both_pairs", ["both_pairs"]))

# --- clusters ----------------------------------------------------------------------
register(Query("grid_clusters", lambda p: p.clusters, clusters.CLUSTER_COLUMNS, "clusters", ["clusters"]))
register(Query("centroid_distance", lambda p: _sel(p.clusters, ["application_id", "cluster_id", "distance_to_centroid"]),
               ["application_id", "cluster_id", "distance_to_centroid"], "clusters", ["clusters"]))
register(Query("sigma_outliers", lambda p: _sel(p.clusters, ["application_id", "cluster_id", "is_cluster_outlier"]),
               ["application_id", "cluster_id", "is_cluster_outlier"], "clusters", ["clusters"]))
register(Query("cluster_disparity", lambda p: _sel(p.clusters, DISPARITY_COLUMNS).distinct(), DISPARITY_COLUMNS,
               "clusters", ["clusters"], ["DISTINCT " + DISPARITY_COLUMNS[0]] + DISPARITY_COLUMNS[1:]))

# --- rules, statistics ---------------------------------------------------------------
register(Query("rule_violations", lambda p: p.violations, VIOLATION_COLUMNS, "violations", ["violations"]))
register(Query("rule_catalogue", lambda p: rules.rule_hits(p.violations, p.rule_specs),
               ["rule_id", "rule_category", "weight", "description", "n_applications"], "rule_hits", ["rule_hits"]))
_LAYERED = ["application_id", "lei", "state_code", "approved", "R002_ai_violation", "R009_ai_violation",
            "total_ai_violation_score", "ai_confidence_level", "ai_violation_severity"]
register(Query("layered_rules", lambda p: p.layered_violations, _LAYERED, "layered", ["layered"]))
register(Query("lender_stats", lambda p: _sel(p.lender_stats, LENDER_STAT_COLUMNS), LENDER_STAT_COLUMNS,
               "lender_stats", ["lender_stats"]))


def _z(p: AuditPipeline) -> DataFrame:
    c = F.col
    t = stats.statistical_tests(p.lender_stats)

    def weighted(a, na, b, nb):
        return stats.two_proportion_z(c(a), c(na), c(b), c(nb), "weighted")

    return t.select(
        "lei", "state_code", "white_black_z_score", "white_hispanic_z_score", "male_female_z_score",
        weighted("white_approval_rate", "white_applications", "black_approval_rate", "black_applications").alias("white_black_z_weighted"),
        weighted("white_approval_rate", "white_applications", "hispanic_approval_rate", "hispanic_applications").alias("white_hispanic_z_weighted"),
        weighted("male_approval_rate", "male_applications", "female_approval_rate", "female_applications").alias("male_female_z_weighted"),
    )


_Z_COLS = ["lei", "state_code", "white_black_z_score", "white_hispanic_z_score", "male_female_z_score",
           "white_black_z_weighted", "white_hispanic_z_weighted", "male_female_z_weighted"]
register(Query("two_proportion_z", _z, _Z_COLS, "statistics", ["statistics"], _Z_COLS[:5] + [
    O.z("white_approval_rate", "white_applications", "black_approval_rate", "black_applications", "weighted") + " AS white_black_z_weighted",
    O.z("white_approval_rate", "white_applications", "hispanic_approval_rate", "hispanic_applications", "weighted") + " AS white_hispanic_z_weighted",
    O.z("male_approval_rate", "male_applications", "female_approval_rate", "female_applications", "weighted") + " AS male_female_z_weighted",
]))
_DI = ["lei", "state_code", "black_white_ratio", "hispanic_white_ratio", "female_male_ratio", "black_disparate_impact",
       "hispanic_disparate_impact", "female_disparate_impact"]
register(Query("disparate_impact", lambda p: _sel(p.statistics, _DI), _DI, "statistics", ["statistics"]))
_EV = ["lei", "state_code", "racial_ai_validation_strength", "gender_ai_validation_strength", "white_black_significant",
       "white_hispanic_significant", "male_female_significant", "ai_enhanced_discrimination_evidence_score"]
register(Query("evidence_score", lambda p: _sel(p.statistics, _EV), _EV, "statistics", ["statistics"]))
register(Query("statistical_analysis", lambda p: _sel(p.statistics, STATISTICS_COLUMNS), STATISTICS_COLUMNS,
               "statistics", ["statistics"]))

# --- assessment and roll-ups --------------------------------------------------------------
register(Query("final_assessment", lambda p: _sel(p.assessment, ASSESSMENT_COLUMNS), ASSESSMENT_COLUMNS,
               "assessment", ["assessment"]))
register(Query("explanations",
               lambda p: _sel(p.assessment, ["application_id", "ai_enhanced_explanation"]),
               ["application_id", "ai_enhanced_explanation"], "assessment", ["assessment"]))
register(Query("lender_risk_summary", lambda p: _sel(p.summary, SUMMARY_COLUMNS), SUMMARY_COLUMNS, "summary", ["summary"]))
register(Query("validation", lambda p: _sel(p.validation, VALIDATION_COLUMNS), VALIDATION_COLUMNS, "validation", ["validation"]))
register(Query("performance_metrics", lambda p: p.metrics, METRIC_COLUMNS, "metrics", ["metrics"]))
_ROC_COLS = ["level", "positives", "negatives", "distinct_scores", "roc_area", "balanced_accuracy"]
register(Query("roc_area", lambda p: p.roc, _ROC_COLS, "roc", ["roc"]))
register(Query("top5_flagged_per_lender", lambda p: report.flagged_samples(p.assessment, p.summary), SAMPLE_COLUMNS,
               "samples", ["samples"], ["lei", "state_code", "CAST(sample_rank AS INTEGER) AS sample_rank"] + report.SAMPLE_FIELDS))
register(Query("compliance_report", lambda p: p.report(nested_samples=False), REPORT_COLUMNS, "report", ["report"]))


def _nested_samples(p: AuditPipeline) -> DataFrame:
    nested = p.report(nested_samples=True)
    rows = nested.select("lender_id", "state_code", F.explode("sample_ai_flagged_applications").alias("s"))
    return rows.select("lender_id", "state_code", "s.*")


register(Query("report_nested_samples", _nested_samples, ["lender_id", "state_code", *report.SAMPLE_FIELDS], "samples",
               ["samples"], ["lei AS lender_id", "state_code", *report.SAMPLE_FIELDS]))
register(Query("dashboard", lambda p: p.dashboard(), DASHBOARD_COLUMNS, "dashboard", ["dashboard"]))
_SUM_COLS = ["status", "confirmation", "ai_summary"]
register(Query(
    "final_summary", lambda p: p.run_summary(with_timestamp=False), _SUM_COLS, "(SELECT 1) one", ["assessment", "pairs", "clusters"],
    [f"{O.sq(V.SUMMARY_STATUS)} AS status", f"{O.sq(V.SUMMARY_CONFIRMATION)} AS confirmation",
     f"printf({O.sq(V.SUMMARY_FORMAT)}, (SELECT count(*) FROM assessment), (SELECT count(*) FROM pairs), "
     "(SELECT count(DISTINCT cluster_id) FROM clusters WHERE cluster_id IS NOT NULL)) AS ai_summary"],
))


def _export(p: AuditPipeline) -> DataFrame:
    nested = p.export(with_metadata=False)
    flat = nested.select(
        "application_id", "lender", "state_code", "demographic_profile.*", "ai_mln_violations.*",
        "ai_validation_evidence.*", "ai_enhanced_mln_risk_score", "ai_regulatory_priority",
        "final_confidence_assessment", "ai_enhanced_explanation", "statistical_context.*",
    )
    return flat.select(*EXPORT_COLUMNS)


register(Query(
    "export_nested", _export, EXPORT_COLUMNS, "assessment WHERE ai_enhanced_mln_risk_score > 0", ["assessment"],
    ["application_id", "lei AS lender", "state_code", "race_category", "ethnicity_category", "gender_category", "approved",
     "R001_ai_violation AS ai_business_logic_violation", "R003_ai_violation AS ai_vector_racial_discrimination",
     "R004_ai_violation AS ai_vector_gender_discrimination", "R005_ai_violation AS ai_vector_ethnic_discrimination",
     "R006_ai_violation AS ai_cluster_minority_area_violation", "R007_ai_violation AS ai_cluster_outlier_violation",
     "R008_ai_violation AS ai_intersectional_violation", "total_ai_violation_score AS total_ai_weighted_violations",
     "ai_confidence_level", "is_cluster_outlier", "cluster_disparity_type", "distance_to_centroid",
     "racial_ai_validation_strength", "gender_ai_validation_strength", "ai_enhanced_discrimination_evidence_score",
     "ai_enhanced_mln_risk_score", "ai_regulatory_priority", "final_confidence_assessment", "ai_enhanced_explanation",
     "white_black_significant", "white_hispanic_significant", "male_female_significant", "black_disparate_impact",
     "hispanic_disparate_impact", "female_disparate_impact"],
))


# --- vector index and K-means model -----------------------------------------------------------
KNN_K = 10
_KNN_COLS = ["vec_id", "neighbour_id", "cosine_distance", "neighbour_rank"]


def _vectors(p: AuditPipeline) -> DataFrame:
    from ..sources.adapter import table_vectors
    return table_vectors(p.spark, p.sf_dir)


def _knn(exact: bool, nprobe: int | None = 2, recall: float | None = None):
    def build(p: AuditPipeline) -> DataFrame:
        from ..operators.vector_index import knn_join
        v = _vectors(p)
        return knn_join(v, v, query_id="vec_id", base_id="vec_id", vector_col="vector", k=KNN_K,
                        nprobe=nprobe, exact=exact, recall=recall)
    return build


_UNIT = "list_transform(v, lambda x: x / sqrt({ss}))".format(ss=O.sumsq("v"))
_KNN_FROM = f"""(
  SELECT a.vec_id, b.vec_id AS neighbour_id,
    CAST(1 AS DOUBLE) - {O.dot('a.u', 'b.u')} AS cosine_distance
  FROM (SELECT vec_id, {_UNIT} AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) x) a
  JOIN (SELECT vec_id, {_UNIT} AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) y) b
    ON a.vec_id <> b.vec_id
) d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine_distance, neighbour_id) <= {KNN_K}"""
_KNN_ITEMS = ["vec_id", "neighbour_id", "cosine_distance",
              "CAST(row_number() OVER (PARTITION BY vec_id ORDER BY cosine_distance, neighbour_id) AS INTEGER) AS neighbour_rank"]
register(Query("knn_exact", _knn(True), _KNN_COLS, _KNN_FROM, [], _KNN_ITEMS))
register(Query("knn_ivf_all_cells", _knn(False, None), _KNN_COLS, _KNN_FROM, [], _KNN_ITEMS))
register(Query("knn_ivf", _knn(False, recall=0.9), _KNN_COLS))


def _knn_pq(p: AuditPipeline) -> DataFrame:
    """Every vector whose id is divisible by 20 asks all vectors."""
    from ..operators.pq_index import pq_knn
    v = _vectors(p)
    return pq_knn(v.where(F.col("vec_id") % 20 == 0), v, query_id="vec_id", base_id="vec_id", vector_col="vector", k=KNN_K)


register(Query("knn_pq", _knn_pq, _KNN_COLS))


def _kmeans(p: AuditPipeline) -> DataFrame:
    from ..operators.vector_index import kmeans_assign
    return kmeans_assign(p.embedded.select("application_id", "profile_embedding"), "profile_embedding",
                         "application_id", k=50, standardize=True)


register(Query("kmeans_assign", _kmeans, ["application_id", "kmeans_cluster"], "km_assigned", ["km_assigned"]))


# --- public API -----------------------------------------------------------------------------
def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    q = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q.build(_pipe(spark, sf_dir, name))
        if q.columns:
            df = df.select(*q.columns)
        return round_doubles(df, ROUND_DIGITS)

    run.__name__ = name
    return run


def _round_expr(expr: str) -> str:
    """Wrap the output column of a SQL select item in round(…, 6) if DOUBLE."""
    alias = expr.rsplit(" AS ", 1)[-1].strip() if " AS " in expr else expr.strip()
    if alias.startswith("DISTINCT "):
        alias = alias[len("DISTINCT "):]
    if alias in DOUBLE_COLUMNS:
        body = expr.rsplit(" AS ", 1)[0] if " AS " in expr else expr
        return f"round({body}, {ROUND_DIGITS}) AS {alias}"
    return expr


def sql_query(name: str) -> str | None:
    q = REGISTRY[name]
    if q.sql_from is None:
        return None
    items = q.sql_columns or q.columns
    distinct = items[0].startswith("DISTINCT ")
    if distinct:
        items = [items[0][len("DISTINCT "):]] + items[1:]
    rendered = ", ".join(_round_expr(e) for e in items)
    select = f"SELECT {'DISTINCT ' if distinct else ''}{rendered} FROM {q.sql_from}"
    return O.with_ctes(select, q.needs)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spark_query(name) for name in REGISTRY}


def oracle_queries() -> dict[str, str]:
    out = {}
    for name in REGISTRY:
        sql = sql_query(name)
        if sql is not None:
            out[name] = sql
    return out
