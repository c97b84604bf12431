"""Validation of lender tiers against statistical ground truth (D41, D42; T12, T13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dlit, safe_divide

# ---- fixed values of the audit -------------------------------------------------
TRUTH_RATIO = 0.75
STRONG = "STRONG_AI_VALIDATION"
HIGH_RISK_TIERS = ("AI_TIER_1_CRITICAL", "AI_TIER_2_HIGH_RISK")
TP, FN, FP, TN = "AI_TRUE_POSITIVE", "AI_FALSE_NEGATIVE", "AI_FALSE_POSITIVE", "AI_TRUE_NEGATIVE"
ENHANCEMENT_NOTE = "AI-Enhanced MLN shows improved precision through vector similarity validation"
# ---------------------------------------------------------------------------------


def validation(summary: DataFrame, statistics: DataFrame, truth_ratio: float = TRUTH_RATIO) -> DataFrame:
    """Ground truth (EXISTS over the 1:1 statistics row -> left join),
    prediction (tier 1-2) and confusion label per lender/state."""
    c = F.col
    s = statistics.select(
        "lei", "state_code",
        (
            ((c("black_white_ratio") < dlit(truth_ratio)) & c("white_black_significant") & (c("racial_ai_validation_strength") == STRONG))
            | ((c("hispanic_white_ratio") < dlit(truth_ratio)) & c("white_hispanic_significant") & (c("racial_ai_validation_strength") == STRONG))
            | ((c("female_male_ratio") < dlit(truth_ratio)) & c("male_female_significant") & (c("gender_ai_validation_strength") == STRONG))
        ).alias("_truth"),
    )
    joined = summary.select(
        "lei", "state_code", "ai_lender_risk_tier", "avg_ai_mln_risk_score", "priority_cases", "confident_cases",
        "avg_racial_ai_validation_score", "avg_gender_ai_validation_score",
    ).join(s, ["lei", "state_code"], "left")
    truth = F.coalesce(c("_truth"), F.lit(False))
    pred = c("ai_lender_risk_tier").isin(*HIGH_RISK_TIERS)
    return joined.withColumns(
        {"ai_verified_discriminatory_lender": truth, "ai_mln_high_risk_prediction": pred}
    ).drop("_truth").withColumn(
        "ai_classification_result",
        F.when(c("ai_verified_discriminatory_lender") & c("ai_mln_high_risk_prediction"), TP)
        .when(c("ai_verified_discriminatory_lender") & ~c("ai_mln_high_risk_prediction"), FN)
        .when(~c("ai_verified_discriminatory_lender") & c("ai_mln_high_risk_prediction"), FP)
        .when(~c("ai_verified_discriminatory_lender") & ~c("ai_mln_high_risk_prediction"), TN),
    )


def performance_metrics(validated: DataFrame) -> DataFrame:
    """Confusion counts and binary-classification metrics in one row.
    The "AUC" is (recall + specificity) / 2 (balanced accuracy)."""
    c = F.col
    r = c("ai_classification_result")
    counts = validated.agg(
        F.count_if(r == TP).alias("ai_true_positives"),
        F.count_if(r == FP).alias("ai_false_positives"),
        F.count_if(r == TN).alias("ai_true_negatives"),
        F.count_if(r == FN).alias("ai_false_negatives"),
        F.count(F.lit(1)).alias("total_lenders_evaluated"),
    )
    tp, fp, tn, fn = (c(x) for x in ("ai_true_positives", "ai_false_positives", "ai_true_negatives", "ai_false_negatives"))
    recall = safe_divide(tp, tp + fn)
    specificity = safe_divide(tn, tn + fp)
    return counts.select(
        "ai_true_positives", "ai_false_positives", "ai_true_negatives", "ai_false_negatives", "total_lenders_evaluated",
        recall.alias("ai_recall_sensitivity"),
        safe_divide(tp, tp + fp).alias("ai_precision"),
        specificity.alias("ai_specificity"),
        safe_divide(tp + tn, tp + fp + tn + fn).alias("ai_accuracy"),
        safe_divide(2 * tp, 2 * tp + fp + fn).alias("ai_f1_score"),
        ((recall + specificity) / dlit(2.0)).alias("ai_auc_approximation"),
        F.lit(ENHANCEMENT_NOTE).alias("ai_enhancement_benefit"),
    )


def roc_area(rows: DataFrame, score: str, truth: str, digits: int = 6) -> DataFrame:
    """The area under the ROC curve of ``score`` against the boolean ``truth``, from rank
    sums: the share of (true, false) pairs in which the true row has the higher score, ties
    counting half. One row: positives, negatives, distinct_scores, roc_area (null without both kinds).

    Rows with a null score or truth don't count; scores are ranked at ``digits`` decimals; NaN ranks highest.
    Rows become counts a score, combined before they move; the scores are dealt by range, so
    the ranks need prefix counts inside a range and one offset a range, never a window over all scores.
    """
    c = F.col
    value = F.round(c(score).cast("double"), digits)
    counts = rows.where(c(score).isNotNull() & c(truth).isNotNull()).groupBy(value.alias("_s")).agg(
        F.count_if(c(truth)).alias("_p"), F.count_if(~c(truth)).alias("_n"))
    # the ranges are numbered once, in the job that also sums them up: no second pass could number them otherwise
    dealt = counts.repartitionByRange("_s").withColumn("_r", F.spark_partition_id())
    below = F.coalesce(F.sum("_n").over(Window.partitionBy("_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    big = "decimal(38,0)"  # products of two counts, summed, pass 64 bits
    ranges = dealt.withColumn("_below", below).groupBy("_r").agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.count("*").alias("_k"),
        F.sum((c("_p").cast("decimal(19,0)") * (2 * c("_below") + c("_n")).cast("decimal(19,0)")).cast(big)).alias("_twice"),
    )
    # one row a range from here on
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = ranges.withColumn("_o", offset).agg(
        F.coalesce(F.sum("_p"), F.lit(0)).alias("positives"), F.coalesce(F.sum("_n"), F.lit(0)).alias("negatives"),
        F.coalesce(F.sum("_k"), F.lit(0)).alias("distinct_scores"),
        F.sum((c("_twice") + 2 * c("_p").cast("decimal(19,0)") * c("_o").cast("decimal(19,0)")).cast(big)).alias("_twice"),
    )
    pairs = c("positives").cast("double") * c("negatives").cast("double")
    return whole.select(
        "positives", "negatives", "distinct_scores", safe_divide(c("_twice").cast("double"), dlit(2.0) * pairs).alias("roc_area")
    )
