"""Branch coverage of the rule, statistics, assessment and roll-up cascades
on hand-made rows (including branches unreachable end-to-end)."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.operators import assess, clusters, evaluate, lenders, rules, stats


def test_two_proportion_z_forms(spark):
    df = spark.createDataFrame(
        [(0.8, 40, 0.5, 40), (0.0, 30, 0.0, 30), (0.9, 29, 0.1, 100), (1.0, 30, 1.0, 30)],
        "p1 double, n1 long, p2 double, n2 long",
    )
    c = F.col
    rows = df.select(
        stats.two_proportion_z(c("p1"), c("n1"), c("p2"), c("n2"), "sum_halves").alias("sh"),
        stats.two_proportion_z(c("p1"), c("n1"), c("p2"), c("n2"), "mean").alias("m"),
        stats.two_proportion_z(c("p1"), c("n1"), c("p2"), c("n2"), "weighted").alias("w"),
    ).collect()
    p = 0.65
    assert abs(rows[0].m - 0.3 / math.sqrt(p * (1 - p) * (2 / 40))) < 1e-12
    assert abs(rows[0].sh - 0.3 / math.sqrt(abs(0.65 * (1 - 1.3) / 2 * (2 / 40)))) < 1e-12
    assert abs(rows[0].w - rows[0].m) < 1e-12  # equal n: weighted == mean pooled
    assert math.isnan(rows[1].sh)  # 0/0 -> NaN (IEEE)
    assert rows[2].sh is None  # n < 30
    assert rows[3].sh == 0.0


def test_evidence_points_cascade(spark):
    df = spark.createDataFrame(
        [(3.0, 0.5, "STRONG_AI_VALIDATION"), (3.0, 0.5, "MODERATE_AI_VALIDATION"), (3.0, 0.5, "WEAK_AI_VALIDATION"),
         (3.0, 0.5, "NO_AI_VALIDATION"), (3.0, 0.9, "STRONG_AI_VALIDATION"), (1.0, 0.5, "STRONG_AI_VALIDATION"),
         (None, None, "STRONG_AI_VALIDATION"), (float("nan"), 0.9, "STRONG_AI_VALIDATION")],
        "z double, r double, s string",
    )
    got = [r.p for r in df.select(stats.evidence_points(F.col("z"), F.col("r"), F.col("s")).alias("p")).collect()]
    assert got == [4, 3, 2, 1, 1, 1, 0, 0]


def test_validation_strength_bands(spark):
    df = spark.createDataFrame([(10,), (9,), (5,), (1,), (0,)], "n long")
    got = [r.s for r in df.select(stats.validation_strength(F.col("n")).alias("s")).collect()]
    assert got == ["STRONG_AI_VALIDATION", "MODERATE_AI_VALIDATION", "MODERATE_AI_VALIDATION", "WEAK_AI_VALIDATION",
                   "NO_AI_VALIDATION"]


VIOL = T.StructType([
    T.StructField("application_id", T.StringType()), T.StructField("lei", T.StringType()),
    T.StructField("state_code", T.StringType()), T.StructField("race_category", T.StringType()),
    T.StructField("ethnicity_category", T.StringType()), T.StructField("gender_category", T.StringType()),
    T.StructField("approved", T.BooleanType()), T.StructField("calculated_dti_ratio", T.DoubleType()),
])
CLUS = T.StructType([
    T.StructField("application_id", T.StringType()), T.StructField("cluster_id", T.LongType()),
    T.StructField("is_cluster_outlier", T.BooleanType()), T.StructField("cluster_disparity_type", T.StringType()),
    T.StructField("distance_to_centroid", T.DoubleType()),
])
EVID = T.StructType([
    T.StructField("application_id", T.StringType()), T.StructField("_pair_R001", T.BooleanType()),
    T.StructField("_pair_R003", T.LongType()), T.StructField("_pair_R004", T.LongType()),
    T.StructField("_pair_R005", T.LongType()), T.StructField("min_distance", T.DoubleType()),
])


def test_rule_branches(spark):
    apps = spark.createDataFrame([
        ("r001", "L", "CA", "White", "Not_Hispanic", "Male", False, 0.2),
        ("r003", "L", "CA", "White", "Not_Hispanic", "Male", True, 0.5),
        ("r006", "L", "CA", "White", "Not_Hispanic", "Male", False, 0.3),
        ("r007", "L", "CA", "Black", "Not_Hispanic", "Male", False, 0.9),
        ("r008", "L", "CA", "Black", "Not_Hispanic", "Female", False, 0.9),
        ("none", "L", "CA", "White", "Not_Hispanic", "Male", True, 0.2),
        ("nocl", "L", "CA", "Black", "Hispanic", "Female", False, 0.1),
    ], VIOL)
    clus = spark.createDataFrame([
        ("r006", 1, True, "NO_CLUSTER_DISPARITY", 0.1),
        ("r007", 1, False, "CLUSTER_RACIAL_DISPARITY", 0.1),
        ("r008", 1, False, "NO_CLUSTER_DISPARITY", 2.1),
        ("none", 1, False, "NO_CLUSTER_DISPARITY", 0.1),
    ], CLUS)
    ev = spark.createDataFrame([
        ("r001", True, 0, 0, 0, 0.04),
        ("r003", False, 2, 1, 0, 0.015),
    ], EVID)
    out = {r.application_id: r for r in rules.evaluate_rules(apps, clus, ev).collect()}
    assert out["r001"].R001_ai_violation == 8.0 and out["r001"].ai_confidence_level == "NO_AI_EVIDENCE"
    assert out["r003"].R003_ai_violation == 18.0 and out["r003"].R004_ai_violation == 8.5
    assert out["r003"].total_ai_violation_score == 26.5 and out["r003"].ai_violation_severity == "AI_CRITICAL"
    assert out["r003"].ai_confidence_level == "HIGH_AI_CONFIDENCE"
    assert out["r006"].R006_ai_violation == 7.0 and out["r006"].ai_confidence_level == "LOW_AI_CONFIDENCE"
    assert out["r007"].R007_ai_violation == 6.5
    assert out["r008"].R008_ai_violation == 6.0 and out["r008"].ai_confidence_level == "HIGH_AI_CONFIDENCE"
    assert out["none"].total_ai_violation_score == 0.0 and out["none"].ai_violation_severity == "AI_LOW"
    assert out["nocl"].cluster_id is None and out["nocl"].total_ai_violation_score == 0.0


def test_rules_table(spark):
    t = rules.rules_table(spark).collect()
    assert [r.rule_id for r in t] == [f"R00{i}" for i in range(1, 10)]
    assert [r.weight for r in t] == [8.0, 7.5, 9.0, 8.5, 8.0, 7.0, 6.5, 6.0, 5.0]


def assessment_rows(spark, rows):
    cols = ("application_id lei state_code race_category ethnicity_category gender_category approved "
            "total_ai_violation_score ai_violation_severity ai_confidence_level R001_ai_violation R003_ai_violation "
            "R004_ai_violation R005_ai_violation R006_ai_violation R007_ai_violation R008_ai_violation cluster_id "
            "is_cluster_outlier cluster_disparity_type distance_to_centroid").split()
    schema = ("application_id string, lei string, state_code string, race_category string, ethnicity_category string, "
              "gender_category string, approved boolean, total_ai_violation_score double, ai_violation_severity string, "
              "ai_confidence_level string, R001_ai_violation double, R003_ai_violation double, R004_ai_violation double, "
              "R005_ai_violation double, R006_ai_violation double, R007_ai_violation double, R008_ai_violation double, "
              "cluster_id long, is_cluster_outlier boolean, cluster_disparity_type string, distance_to_centroid double")
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], schema)


def base_row(**over):
    r = dict(application_id="a", lei="L", state_code="CA", race_category="White", ethnicity_category="Not_Hispanic",
             gender_category="Male", approved=True, total_ai_violation_score=0.0, ai_violation_severity="AI_LOW",
             ai_confidence_level="NO_AI_EVIDENCE", R001_ai_violation=0.0, R003_ai_violation=0.0,
             R004_ai_violation=0.0, R005_ai_violation=0.0, R006_ai_violation=0.0, R007_ai_violation=0.0,
             R008_ai_violation=0.0, cluster_id=None, is_cluster_outlier=None, cluster_disparity_type=None,
             distance_to_centroid=None)
    r.update(over)
    return r


def test_assessment_risk_null_and_cap(spark):
    viol = assessment_rows(spark, [
        base_row(application_id="capped", total_ai_violation_score=27.0, R003_ai_violation=27.0,
                 ai_violation_severity="AI_CRITICAL", ai_confidence_level="HIGH_AI_CONFIDENCE",
                 is_cluster_outlier=True, cluster_disparity_type="CLUSTER_RACIAL_DISPARITY"),
        base_row(application_id="nostats", lei="M", total_ai_violation_score=8.0, R001_ai_violation=8.0),
        base_row(application_id="zero"),
    ])
    st = spark.createDataFrame(
        [("L", "CA", 6, True, False, False, True, False, False, "STRONG_AI_VALIDATION", "NO_AI_VALIDATION")],
        "lei string, state_code string, ai_enhanced_discrimination_evidence_score int, white_black_significant boolean, "
        "white_hispanic_significant boolean, male_female_significant boolean, black_disparate_impact boolean, "
        "hispanic_disparate_impact boolean, female_disparate_impact boolean, racial_ai_validation_strength string, "
        "gender_ai_validation_strength string",
    )
    out = {r.application_id: r for r in assess.final_assessment(viol, st).collect()}
    cap = out["capped"]
    assert cap.ai_enhanced_mln_risk_score == 100.0
    assert cap.final_confidence_assessment == "VERY_HIGH_CONFIDENCE"
    assert cap.ai_regulatory_priority == "AI_IMMEDIATE_INVESTIGATION"
    assert cap.ai_enhanced_explanation.split("; ") == [
        "AI-verified: Vector similarity shows racial discrimination in similar financial profiles",
        "AI clustering: Application is statistical outlier in embedding space",
        "AI cluster disparity: CLUSTER_RACIAL_DISPARITY detected",
    ]
    ns = out["nostats"]
    assert ns.ai_enhanced_mln_risk_score is None and ns.ai_regulatory_priority == "AI_LOW_RISK"
    assert ns.final_confidence_assessment == "LOW_CONFIDENCE"
    z = out["zero"]
    assert z.ai_enhanced_mln_risk_score == 48.0 and z.ai_enhanced_explanation == ""
    assert z.final_confidence_assessment == "LOW_CONFIDENCE" and z.ai_regulatory_priority == "AI_MONITORING_REQUIRED"


def test_lender_tier_and_flags(spark):
    base = {c: 0 for c in ["ai_immediate_investigation_cases", "ai_critical_violations", "very_high_confidence_cases",
                           "confident_cases", "ai_high_priority_cases", "serious_ai_violations",
                           "cluster_racial_disparity_count", "priority_cases", "cluster_outlier_count"]}
    fl = {"avg_ai_mln_risk_score": 0.0, "avg_racial_ai_validation_score": 0.0, "avg_cluster_distance": 0.0,
          "avg_black_ai_risk_score": None, "avg_white_male_ai_risk_score": 10.0, "avg_gender_ai_validation_score": 0.0}
    cases = [
        ({"ai_immediate_investigation_cases": 5}, {}, "AI_TIER_1_CRITICAL"),
        ({"cluster_racial_disparity_count": 5}, {"avg_racial_ai_validation_score": 2.0}, "AI_TIER_2_HIGH_RISK"),
        ({"cluster_outlier_count": 20}, {"avg_cluster_distance": 1.5}, "AI_TIER_3_ELEVATED_RISK"),
        ({}, {"avg_ai_mln_risk_score": 5.0}, "AI_TIER_4_MONITORING"),
        ({}, {}, "AI_TIER_5_LOW_RISK"),
    ]
    rows = []
    for i, (ints, dbls, _) in enumerate(cases):
        r = {**base, **ints, **fl, **dbls}
        rows.append(tuple([i] + [r[k] for k in base] + [r[k] for k in fl]))
    schema = "i int, " + ", ".join(f"{k} long" for k in base) + ", " + ", ".join(f"{k} double" for k in fl)
    df = spark.createDataFrame(rows, schema).withColumn("tier", lenders.risk_tier()).withColumn(
        "black", lenders.disparity_flag("avg_black_ai_risk_score", "avg_racial_ai_validation_score", "BLACK")
    ).withColumn("red", lenders.redlining_flag())
    got = {r.i: r for r in df.collect()}
    assert [got[i].tier for i in range(5)] == [c[2] for c in cases]
    assert got[1].red == "AI_VERIFIED_REDLINING_PATTERN" and got[0].red == "NO_AI_REDLINING_PATTERN"
    assert got[0].black == "NO_AI_BLACK_DISPARITY"


def test_performance_metrics_confusion_edges(spark):
    df = spark.createDataFrame([("AI_TRUE_NEGATIVE",), ("AI_FALSE_POSITIVE",)], "ai_classification_result string")
    m = evaluate.performance_metrics(df).first()
    assert m.ai_recall_sensitivity is None and m.ai_precision == 0.0 and m.ai_specificity == 0.5
    assert m.ai_auc_approximation is None and m.total_lenders_evaluated == 2


def test_cluster_min_size_and_outlier(spark):
    rows = []
    for i in range(19):  # 19 rows in one cell: dropped
        rows.append((f"a{i}", "L", "CA", "White", "Not_Hispanic", "Male", True, [0.0, 0.0, 0.0]))
    for i in range(20):  # 20 rows: kept; one far point
        v = [0.05 if i == 0 else 0.0, 0.5, 0.5]
        rows.append((f"b{i}", "L", "NY", "White", "Not_Hispanic", "Male", True, v))
    df = spark.createDataFrame(rows, "application_id string, lei string, state_code string, race_category string, "
                                     "ethnicity_category string, gender_category string, approved boolean, "
                                     "profile_embedding array<double>")
    out = clusters.grid_clusters(df).collect()
    assert len(out) == 20 and all(r.state_code == "NY" for r in out)
    flagged = [r.application_id for r in out if r.is_cluster_outlier]
    assert flagged == ["b0"]
    assert out[0].cluster_size_category == "OPTIMAL_SIZE" and out[0].cluster_disparity_type == "NO_CLUSTER_DISPARITY"


def test_undefined_metrics_are_null_in_the_dashboard(spark, small_pipeline):
    from lendlens.operators import evaluate, report

    def empty(df):
        return spark.createDataFrame([], df.schema)

    names = ("embedded", "pairs", "clusters", "assessment", "summary", "statistics")
    rows = report.dashboard(
        spark, **{k: empty(getattr(small_pipeline, k)) for k in names},
        metrics=evaluate.performance_metrics(empty(small_pipeline.validation)),
        report=empty(small_pipeline.report(nested_samples=False)),
    )
    values = {r["metric_name"]: r["metric_value"] for r in rows.collect()}
    assert values["AI-Enhanced F1-Score"] is None and values["AI-Enhanced AUC Score"] is None
    assert values["AI-Enhanced Model Accuracy"] is None
