"""End-to-end properties of the audit on the smallest test tables, the driver
entry point, and embedder consistency."""

import os
import sys

from pyspark.sql import functions as F

from lendlens.operators import embed

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_pipeline_properties(small_pipeline):
    p = small_pipeline
    a = p.assessment
    bad_risk = a.where(F.col("ai_enhanced_mln_risk_score").isNotNull()
                       & ~F.col("ai_enhanced_mln_risk_score").between(0, 100)).count()
    assert bad_risk == 0
    st = p.statistics
    assert st.where(~F.col("ai_enhanced_discrimination_evidence_score").between(0, 12)).count() == 0
    per_base = p.pairs.groupBy("base_app_id").count().agg(F.max("count")).first()[0]
    assert per_base <= 5
    assert p.pairs.where(F.col("base_app_id") >= F.col("similar_app_id")).count() == 0
    v = p.violations
    approved_side = (F.col("R003_ai_violation") + F.col("R004_ai_violation") + F.col("R005_ai_violation")) > 0
    denied_side = (F.col("R001_ai_violation") + F.col("R006_ai_violation") + F.col("R007_ai_violation")
                   + F.col("R008_ai_violation")) > 0
    assert v.where(approved_side & denied_side).count() == 0
    m = p.metrics.first()
    assert (m.ai_true_positives + m.ai_false_positives + m.ai_true_negatives + m.ai_false_negatives
            == m.total_lenders_evaluated == p.summary.count())
    assert p.dashboard().count() == 27
    nested = p.report().first()
    if nested is not None:
        assert 1 <= len(nested.sample_ai_flagged_applications) <= 5
        risks = [s.ai_enhanced_mln_risk_score for s in nested.sample_ai_flagged_applications]
        assert risks == sorted(risks, reverse=True)


def test_entry_smoke(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and "ai_lender_risk_tier" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dense_and_sparse_hash_embeddings_agree(spark):
    texts = spark.createDataFrame(
        [("a", "Mortgage application for White Not_Hispanic Male applicant. Loan $200K"), ("b", "x x x y"), ("c", "")],
        "id string, text string",
    )
    sparse = {(r.id, r.slot): r.value for r in embed.hash_embedding_sparse(texts, "id", "text", dim=16).collect()}
    dense = texts.select("id", embed.hash_embedding(F.col("text"), 16).alias("v")).collect()
    for r in dense:
        for slot, value in enumerate(r.v):
            assert abs(sparse.get((r.id, slot), 0.0) - value) < 1e-12
    assert all(x == 0.0 for x in [r.v for r in dense if r.id == "c"][0])


def test_csv_path_with_text_embedder(spark, tmp_path):
    """Raw CSV -> content-hash ids -> feature-hashing embedder -> whole audit."""
    import random

    from lendlens.plans import AuditPipeline
    from lendlens.sources.raw import RAW_COLUMNS, read_raw_csv

    rnd = random.Random(1)
    lines = [",".join(RAW_COLUMNS)]
    for i in range(120):
        race = rnd.choice(["5", "3", "2"])
        row = {c: "" for c in RAW_COLUMNS}
        row.update(lei="BANK1", activity_year="2024", state_code="CA", county_code="1", census_tract=str(i),
                   applicant_ethnicity_1=rnd.choice(["1", "2"]), applicant_race_1=race,
                   applicant_sex=rnd.choice(["1", "2"]), applicant_age="35-44", income=str(rnd.choice([60, 62, 100])),
                   loan_amount=str(rnd.choice([200, 205, 300])), rate_spread="0.5", debt_to_income_ratio="36",
                   loan_type="1", loan_purpose="1", occupancy_type="1", derived_dwelling_category="SF",
                   derived_loan_product_type="Conv", lien_status="1", tract_population="1000",
                   tract_minority_population_percent="30", ffiec_msa_md_median_family_income="90000",
                   tract_to_msa_income_percentage="100",
                   action_taken="1" if (race == "5" or rnd.random() < 0.4) else "3")
        lines.append(",".join(row[c] for c in RAW_COLUMNS))
    path = tmp_path / "apps.csv"
    path.write_text("\n".join(lines) + "\n")
    raw = read_raw_csv(spark, str(path))
    audit = AuditPipeline(spark, raw=raw, profile_embedder=lambda t: embed.hash_embedding(t, 16),
                          financial_embedder=lambda t: embed.hash_embedding(t, 16), materialize=True)
    assert audit.embedded.count() == 120
    ids = [r.application_id for r in audit.embedded.select("application_id").collect()]
    assert len(set(ids)) == 120
    assert audit.statistics.count() == 1
    assert audit.summary.count() == 1
    assert audit.dashboard().count() == 27


def test_bucketed_stages_match_plain_stages(spark):
    from lendlens.plans import AuditPipeline

    plain = AuditPipeline(spark, "/root/testdata/sf0.001", materialize=True)
    bucketed = AuditPipeline(spark, "/root/testdata/sf0.001", materialize=True, bucket_stages=True, buckets=4)
    cols = ["application_id", "total_ai_violation_score", "ai_confidence_level"]
    a, b = plain.violations.select(*cols), bucketed.violations.select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    view = bucketed.export(with_metadata=False, view_name="audit_export")
    assert spark.table("audit_export").count() == view.count()


def test_batch_job_writes_every_stage(spark, tmp_path):
    from lendlens.plans.run import run

    written = run(spark, str(tmp_path / "out"), tables="/root/testdata/sf0.001")
    assert len(written) == 15
    assert spark.read.parquet(written["lender_risk_summary"]).count() == 10
    assert spark.read.parquet(written["system_dashboard"]).count() == 27


def test_stages_to_store_counts_readers():
    from lendlens.plans.pipeline import stages_to_store

    assert stages_to_store(["pairs"]) == {"embedded"}  # both sides of the self-join read the applications
    assert stages_to_store(["evidence"]) == {"embedded"}  # pairs are read once (by the aggregate)
    assert stages_to_store(["violations"]) == {"embedded"}  # read by pairs, clusters and the join
    assert stages_to_store(["assessment"]) == {"embedded", "violations"}
    assert {"pairs", "clusters", "assessment", "summary"} <= stages_to_store(["dashboard"])


def test_create_only_finance_table(small_pipeline, tmp_path):
    import pytest

    path = str(tmp_path / "finance")
    first = small_pipeline.finance_table(path)
    assert "profile_embedding" not in first.columns and first.count() == small_pipeline.embedded.count()
    with pytest.raises(Exception):  # CREATE TABLE (no OR REPLACE) fails when the table exists
        small_pipeline.finance_table(path)


def test_ordered_dashboard_and_report(small_pipeline):
    rows = small_pipeline.dashboard(ordered=True).collect()
    headers = [r.section_header for r in rows]
    assert headers == sorted(headers)
    tiers = [r.ai_lender_risk_tier for r in small_pipeline.report(nested_samples=False, ordered=True).collect()]
    assert tiers == sorted(tiers)  # tier 1 before tier 2
