"""Weighted logic rules held as data and evaluated as columns (D11, D17-D26; T8).

A :class:`RuleSpec` carries the rule's id, category, weight, its formula and
description (documentation text, shown in the rules table) and up to two
column predicates:

* ``row``  -- over the application row (joined with its cluster);
* ``pair`` -- over the application's similarity pairs (base side), with
  ``pair_mode`` ``"exists"`` (weight once when any pair matches) or
  ``"count"`` (weight per matching pair).

All pair predicates of all rules are evaluated in ONE aggregate over the
pairs grouped by base application, and that aggregate is left-joined once
(instead of one correlated subquery per rule).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import dlit
from . import pairs as P

# ---- fixed values of the audit -------------------------------------------------
MINORITY_RACES = ("Black", "Asian", "American_Indian", "Hawaiian_Pacific")
LOW_DTI_R001, LOW_DTI_R006 = 0.28, 0.35
INTERSECTIONAL_DISTANCE = 1.5
HIGH_PAIR_DISTANCE, MEDIUM_PAIR_DISTANCE = 0.02, 0.05
HIGH_CENTROID_DISTANCE, MEDIUM_CENTROID_DISTANCE = 2.0, 1.5
SEVERITY_BANDS = [(15.0, "AI_CRITICAL"), (8.0, "AI_HIGH"), (3.0, "AI_MEDIUM")]
SEVERITY_DEFAULT = "AI_LOW"
HIGH_EVIDENCE, MEDIUM_EVIDENCE, LOW_EVIDENCE = "HIGH_AI_CONFIDENCE", "MEDIUM_AI_CONFIDENCE", "LOW_AI_CONFIDENCE"
NO_EVIDENCE = "NO_AI_EVIDENCE"
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleSpec:
    rule_id: str
    rule_category: str
    weight: float
    formula: str
    description: str
    row: Column | None = None
    pair: Column | None = None
    pair_mode: str = "count"  # "count" | "exists"
    evidence: str | None = None  # "pair" | "cluster": which evidence backs the rule
    reads: tuple[str, ...] = ()  # columns ``row`` needs beyond those of the violation table (see layers.py)

    @property
    def evaluated(self) -> bool:
        return self.row is not None or self.pair is not None

    @property
    def column(self) -> str:
        return f"{self.rule_id}_ai_violation"


def default_rules(minority_races: Sequence[str] = MINORITY_RACES,
                  intersectional_distance: float = INTERSECTIONAL_DISTANCE) -> list[RuleSpec]:
    """The audit's nine rules; R002 and R009 are documented but not evaluated."""
    c = F.col
    races = list(minority_races)
    denied_neighbour = (
        (c("outcome_difference_type") == P.OUTCOME_DIFFERENCE) & c("base_approved") & ~c("similar_approved")
    )
    # ---- fixed values: rule ids, categories, weights, formulas, descriptions ----
    return [
        RuleSpec(
            "R001", "Core_Business", 8.0,
            "AI_ENHANCED: FOR ALL x: HighIncome(x) AND LowDTI(x) AND PrimeRate(x) AND SimilarApproved(x) IMPLIES Approved(x)",
            "High income applicants with similar approved profiles should be approved",
            row=(c("calculated_dti_ratio") <= dlit(LOW_DTI_R001)) & ~c("approved"),
            pair=c("similar_approved") & (c("demographic_difference_type") == P.SAME_DEMOGRAPHICS),
            pair_mode="exists",
        ),
        RuleSpec(
            "R002", "Core_Business", 7.5,
            "AI_ENHANCED: FOR ALL x: LowIncome(x) AND HighDTI(x) AND SubprimeRate(x) AND SimilarDenied(x) IMPLIES NOT Approved(x)",
            "High risk applicants with similar denied profiles should face scrutiny",
        ),
        RuleSpec(
            "R003", "Fair_Lending_AI", 9.0,
            "AI_VECTOR: FOR ALL x, y: VectorSimilar(FinancialProfile(x), FinancialProfile(y), 0.95) AND White(x) AND Black(y) AND SameLender(x, y) AND Approved(x) AND NOT Approved(y) IMPLIES DiscriminatoryPattern(Lender(y))",
            "Financially similar applicants should have similar outcomes regardless of race - AI verified",
            pair=(c("demographic_difference_type") == P.RACE_DIFFERENCE) & denied_neighbour
            & (c("base_race") == "White") & c("similar_race").isin(*races),
            evidence="pair",
        ),
        RuleSpec(
            "R004", "Fair_Lending_AI", 8.5,
            "AI_VECTOR: FOR ALL x, y: VectorSimilar(FinancialProfile(x), FinancialProfile(y), 0.95) AND Male(x) AND Female(y) AND SameLender(x, y) AND Approved(x) AND NOT Approved(y) IMPLIES DiscriminatoryPattern(Lender(y))",
            "Financially similar applicants should have similar outcomes regardless of gender - AI verified",
            pair=(c("demographic_difference_type") == P.GENDER_DIFFERENCE) & denied_neighbour
            & (c("base_gender") == "Male") & (c("similar_gender") == "Female"),
            evidence="pair",
        ),
        RuleSpec(
            "R005", "Fair_Lending_AI", 8.0,
            "AI_VECTOR: FOR ALL x, y: VectorSimilar(FinancialProfile(x), FinancialProfile(y), 0.95) AND NOT Hispanic(x) AND Hispanic(y) AND SameLender(x, y) AND Approved(x) AND NOT Approved(y) IMPLIES DiscriminatoryPattern(Lender(y))",
            "Financially similar applicants should have similar outcomes regardless of ethnicity - AI verified",
            pair=(c("demographic_difference_type") == P.ETHNICITY_DIFFERENCE) & denied_neighbour
            & (c("base_ethnicity") == "Not_Hispanic") & (c("similar_ethnicity") == "Hispanic"),
            evidence="pair",
        ),
        RuleSpec(
            "R006", "AI_Pattern_Detection", 7.0,
            "AI_CLUSTER: FOR ALL x: HighIncome(x) AND LowDTI(x) AND HighMinorityArea(x) AND ClusterAnomaly(x) AND NOT Approved(x) IMPLIES SuspiciousPattern(x)",
            "AI detected anomalous denials in minority areas",
            row=(c("calculated_dti_ratio") <= dlit(LOW_DTI_R006)) & (c("is_cluster_outlier") == F.lit(True)) & ~c("approved"),
            evidence="cluster",
        ),
        RuleSpec(
            "R007", "AI_Pattern_Detection", 6.5,
            "AI_CLUSTER: FOR ALL x: VectorOutlier(x, ApprovedCluster) AND MinorityApplicant(x) AND NOT Approved(x) IMPLIES PotentialRedlining(x)",
            "AI identified outliers in minority lending patterns",
            row=(c("cluster_disparity_type") != "NO_CLUSTER_DISPARITY") & c("race_category").isin(*races) & ~c("approved"),
            evidence="cluster",
        ),
        RuleSpec(
            "R008", "AI_Intersectional", 6.0,
            "AI_MULTI: FOR ALL x: Black(x) AND Female(x) AND LowIncomeArea(x) AND MultiDimensionalAnomaly(x) AND NOT Approved(x) IMPLIES IntersectionalDiscrimination(x)",
            "AI detected intersectional discrimination patterns",
            row=(c("race_category") == "Black") & (c("gender_category") == "Female")
            & (c("distance_to_centroid") > dlit(intersectional_distance)) & ~c("approved"),
            evidence="cluster",
        ),
        RuleSpec(
            "R009", "AI_Validation", 5.0,
            "AI_CONFIDENCE: FOR ALL x: AIDiscriminationConfidence(x) > 0.85 AND StatisticalSignificance(x) IMPLIES HighConfidenceViolation(x)",
            "High confidence AI discrimination detection with statistical support",
        ),
    ]
    # -------------------------------------------------------------------------------


RULES_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_category", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("formula", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)


def rules_table(spark, rules: Sequence[RuleSpec] | None = None) -> DataFrame:
    """The rule specs as a table (documentation rows)."""
    rules = rules or default_rules()
    rows = [(r.rule_id, r.rule_category, float(r.weight), r.formula, r.description) for r in rules]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def rule_hits(violations: DataFrame, rules: Sequence[RuleSpec] | None = None) -> DataFrame:
    """The rule catalogue with the number of applications that each rule hits."""
    rules = rules or default_rules()
    hits = F.filter(
        F.array(*[F.when(F.col(r.column) > 0, F.lit(r.rule_id)) for r in rules if r.evaluated]), lambda x: x.isNotNull()
    )
    counts = violations.select(F.explode(hits).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n"))
    table = rules_table(violations.sparkSession, rules)
    return table.join(counts, "rule_id", "left").select(
        "rule_id", "rule_category", "weight", "description", F.coalesce("n", F.lit(0)).alias("n_applications")
    )


def pair_evidence(pairs: DataFrame, rules: Sequence[RuleSpec] | None = None) -> DataFrame:
    """One aggregate per base application with every pair-scoped fact.

    ``_pair_<rule>`` (count or exists per rule), ``min_distance``,
    ``has_race_pair``, ``has_gender_pair``. Each base has at most ``top_k``
    pairs, so no group is large.
    """
    rules = [r for r in (rules or default_rules()) if r.pair is not None]
    c = F.col
    aggs = []
    for r in rules:
        if r.pair_mode == "exists":
            aggs.append(F.bool_or(r.pair).alias(f"_pair_{r.rule_id}"))
        else:
            aggs.append(F.count_if(r.pair).alias(f"_pair_{r.rule_id}"))
    aggs += [
        F.min("financial_similarity_distance").alias("min_distance"),
        F.bool_or(c("demographic_difference_type") == P.RACE_DIFFERENCE).alias("has_race_pair"),
        F.bool_or(c("demographic_difference_type") == P.GENDER_DIFFERENCE).alias("has_gender_pair"),
    ]
    return pairs.groupBy(c("base_app_id").alias("application_id")).agg(*aggs)


VIOLATION_BASE = [
    "application_id", "lei", "state_code", "race_category", "ethnicity_category", "gender_category",
    "approved", "calculated_dti_ratio", "cluster_id", "is_cluster_outlier", "cluster_disparity_type",
    "distance_to_centroid",
]


VIOLATION_TOTALS = ("total_ai_violation_score", "ai_confidence_level", "ai_violation_severity")


def severity() -> Column:
    """The band of the total score."""
    cases = None
    for bound, label in SEVERITY_BANDS:
        cond = F.col("total_ai_violation_score") >= dlit(bound)
        cases = F.when(cond, label) if cases is None else cases.when(cond, label)
    return cases.otherwise(SEVERITY_DEFAULT)


def evaluate_rules(
    embedded: DataFrame,
    clusters: DataFrame,
    evidence: DataFrame,
    rules: Sequence[RuleSpec] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Rule scores, total, evidence level and severity per application.

    ``carry`` names extra evidence columns to keep (e.g. ``has_race_pair``),
    so later per-lender statistics can aggregate this table directly instead
    of joining applications, clusters and evidence a second time.
    """
    rules = [r for r in (rules or default_rules()) if r.evaluated]
    c = F.col
    apps = embedded.select("application_id", "lei", "state_code", "race_category", "ethnicity_category",
                           "gender_category", "approved", "calculated_dti_ratio",
                           *sorted({name for r in rules for name in r.reads if name in embedded.columns}))
    clus = clusters.select("application_id", "cluster_id", "is_cluster_outlier", "cluster_disparity_type",
                           "distance_to_centroid")
    joined = apps.join(clus, "application_id", "left").join(evidence, "application_id", "left")

    scores = {}
    for r in rules:
        w = dlit(r.weight)
        row = r.row if r.row is not None else F.lit(True)
        if r.pair is None:
            scores[r.column] = F.when(row, w).otherwise(dlit(0.0))
        elif r.pair_mode == "exists":
            scores[r.column] = F.when(row & F.coalesce(c(f"_pair_{r.rule_id}"), F.lit(False)), w).otherwise(dlit(0.0))
        else:
            count = F.coalesce(c(f"_pair_{r.rule_id}"), F.lit(0))
            scores[r.column] = F.when(row & (count > 0), w * count).otherwise(dlit(0.0))
    scored = joined.withColumns(scores)

    total = None
    for r in rules:
        total = c(r.column) if total is None else total + c(r.column)
    pair_rules = [r for r in rules if r.evidence == "pair"]
    cluster_rules = [r for r in rules if r.evidence == "cluster"]

    def any_positive(rs):
        cond = F.lit(False)
        for r in rs:
            cond = cond | (c(r.column) > 0)
        return cond

    level = (
        F.when(
            any_positive(pair_rules),
            F.when(c("min_distance") < dlit(HIGH_PAIR_DISTANCE), HIGH_EVIDENCE)
            .when(c("min_distance") < dlit(MEDIUM_PAIR_DISTANCE), MEDIUM_EVIDENCE)
            .otherwise(LOW_EVIDENCE),
        )
        .when(
            any_positive(cluster_rules),
            F.when(c("distance_to_centroid") > dlit(HIGH_CENTROID_DISTANCE), HIGH_EVIDENCE)
            .when(c("distance_to_centroid") > dlit(MEDIUM_CENTROID_DISTANCE), MEDIUM_EVIDENCE)
            .otherwise(LOW_EVIDENCE),
        )
        .otherwise(NO_EVIDENCE)
    )
    scored = scored.withColumn("total_ai_violation_score", total)
    out = scored.withColumns({"ai_confidence_level": level, "ai_violation_severity": severity()})
    return out.select(*VIOLATION_BASE, *[r.column for r in rules], *VIOLATION_TOTALS, *carry)
