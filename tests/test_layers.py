"""Rules in layers (R002, R009), their order, and the ROC area against brute force."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lendlens.operators import evaluate, layers, rules

CLUS = "application_id string, cluster_id long, is_cluster_outlier boolean, cluster_disparity_type string, distance_to_centroid double"

APPS = ("application_id string, lei string, state_code string, race_category string, ethnicity_category string, gender_category string, "
        "approved boolean, calculated_dti_ratio double, income double, rate_spread_adj double")
PAIRS = ("base_app_id string, similar_approved boolean, base_approved boolean, demographic_difference_type string, outcome_difference_type string, "
         "base_race string, similar_race string, base_gender string, similar_gender string, base_ethnicity string, similar_ethnicity string, "
         "financial_similarity_distance double")


def app(k, lei="L", approved=True, dti=0.5, income=40.0, spread=2.0):
    return (k, lei, "CA", "White", "Not_Hispanic", "Male", approved, dti, income, spread)


def pair(k, approved, kind="SAME_DEMOGRAPHICS", base=True, race="White"):
    outcome = "SAME_OUTCOME" if approved == base else "OUTCOME_DIFFERENCE"
    return (k, approved, base, kind, outcome, "White", race, "Male", "Male", "Not_Hispanic", "Not_Hispanic", 0.01)


def spec(name, *reads):
    return rules.RuleSpec(name, "c", 1.0, "", "", row=F.lit(True), reads=reads)


def test_order_follows_reads(spark):
    got = layers.rule_layers(layers.layered_rules())
    assert [[r.rule_id for r in layer] for layer in got] == [[f"R00{i}" for i in range(1, 9)], ["R009"]]
    chain = [spec("C", "B_ai_violation"), spec("B", "A_ai_violation"), spec("A"), spec("S", "white_black_significant")]
    assert [sorted(r.rule_id for r in layer) for layer in layers.rule_layers(chain)] == [["A"], ["B", "S"], ["C"]]
    assert layers.rule_layers([]) == []
    with pytest.raises(ValueError, match="read each other"):
        layers.rule_layers([spec("A", "B_ai_violation"), spec("B", "A_ai_violation")])
    with pytest.raises(ValueError, match="pair predicate"):
        layers.rule_layers([replace(spec("A", "ai_confidence_level"), pair=F.lit(True))])


def test_layered_scores(spark):
    apps = spark.createDataFrame([
        app("hit"), app("rich", income=50.0), app("edge", dti=0.43), app("prime", spread=1.4), app("out", approved=False), app("other"),
        app("like"), app("alone", dti=0.3), app("null", income=None), app("sure", dti=0.3), app("quiet", "M", dti=0.3), app("nostat", "N", dti=0.3),
    ], APPS)
    pairs = spark.createDataFrame(
        [pair(k, False) for k in ("hit", "rich", "edge", "prime", "out", "null")] + [pair("hit", True), pair("like", True)]
        + [pair(k, False, "RACE_DIFFERENCE", race="Black") for k in ("sure", "quiet", "nostat", "alone")]
        + [pair("other", False, "GENDER_DIFFERENCE")], PAIRS)
    stats = spark.createDataFrame([("L", "CA", None, False, True), ("M", "CA", False, None, False)],
                                  "lei string, state_code string, white_black_significant boolean, "
                                  "white_hispanic_significant boolean, male_female_significant boolean")
    seen = []
    out = layers.evaluate_layers(apps, spark.createDataFrame([], CLUS), pairs, layers.layered_rules(),
                                 lambda v: seen.append(set(v.columns)) or stats)
    got = {r.application_id: r for r in out.collect()}
    assert len(got) == 12 and {k for k, r in got.items() if r.R002_ai_violation} == {"hit", "other"}
    assert got["hit"].R002_ai_violation == 7.5 and got["hit"].total_ai_violation_score == 7.5
    assert {k for k, r in got.items() if r.R009_ai_violation} == {"sure", "alone"}
    assert got["sure"].total_ai_violation_score == 14.0 and got["sure"].ai_violation_severity == "AI_HIGH"
    assert got["quiet"].total_ai_violation_score == 9.0 and got["nostat"].R009_ai_violation == 0.0
    # the statistics see the first layer's scores, R002's among them, and no others
    assert {"R002_ai_violation", "has_race_pair"} <= seen[0] and "R009_ai_violation" not in seen[0]


def test_default_rules_unchanged(spark):
    assert [r.rule_id for r in rules.default_rules() if not r.evaluated] == ["R002", "R009"]


@pytest.mark.parametrize("kinds", [1, 5, 1000])
def test_roc_area(spark, kinds):
    rng = random.Random(kinds)
    rows = [(float(rng.randrange(kinds)) / 7, rng.random() < 0.3) for _ in range(400)] + [(None, True), (1.0, None), (math.nan, True)]
    df = spark.createDataFrame(rows, "s double, good boolean").repartition(5)
    key = [((1, 0.0) if math.isnan(s) else (0, round(s, 6)), g) for s, g in rows if s is not None and g is not None]
    good, bad = [s for s, g in key if g], [s for s, g in key if not g]
    want = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    r = evaluate.roc_area(df, "s", "good").first()
    assert (r.positives, r.negatives, r.distinct_scores) == (len(good), len(bad), len({s for s, _ in key}))
    assert abs(r.roc_area - want) < 1e-12


def test_roc_area_of_one_kind(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "s double, good boolean")
    assert evaluate.roc_area(df, "s", "good").first().asDict() == {"positives": 2, "negatives": 0, "distinct_scores": 2, "roc_area": None}
    assert evaluate.roc_area(df.where("s > 9"), "s", "good").first().asDict() == {
        "positives": 0, "negatives": 0, "distinct_scores": 0, "roc_area": None}
