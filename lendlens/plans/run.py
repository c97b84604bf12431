"""Batch job: run the whole audit and store every stage table.

    python -m lendlens.plans.run --csv 's3://bucket/applications/*.csv' --out s3://bucket/audit/2024
    python -m lendlens.plans.run --tables /root/testdata/sf0.1 --out /tmp/audit-out

The output folder gets one parquet table per stage of the audited script
(features, profiles, embeddings, similar pairs, clusters, violations,
statistics, assessment, lender summary, validation, metrics, compliance
report, dashboard, export). Reused stages are stored once under the session's
``spark.checkpoint.dir`` while the job runs.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from ..session import configure
from ..sources import read_raw_csv, write_table
from .pipeline import AuditPipeline


def run(spark: SparkSession, out: str, *, csv: str | None = None, tables: str | None = None) -> dict[str, str]:
    configure(spark)
    if csv:
        audit = AuditPipeline(spark, raw=read_raw_csv(spark, csv), materialize=True)
    else:
        audit = AuditPipeline(spark, tables, materialize=True)
    outputs = {
        "hmda_audit_features": (audit.features.drop("source_key"), ("state_code",)),
        "application_profiles": (audit.profiles.drop("source_key"), ("state_code",)),
        "application_embeddings": (audit.embedded, ("state_code",)),
        "vector_similar_pairs": (audit.pairs, ("state_code",)),
        "cluster_analysis": (audit.clusters, ("state_code",)),
        "mln_violations": (audit.violations.drop("has_race_pair", "has_gender_pair"), ("state_code",)),
        "statistical_analysis": (audit.statistics, ()),
        "final_assessment": (audit.assessment, ("state_code",)),
        "lender_risk_summary": (audit.summary, ()),
        "mln_validation": (audit.validation, ()),
        "performance_metrics": (audit.metrics, ()),
        "regulatory_compliance_report": (audit.report(ordered=True), ()),
        "system_dashboard": (audit.dashboard(ordered=True), ()),
        "export_final": (audit.export(), ("state_code",)),
        "mln_rules": (audit.rules_table(), ()),
    }
    written = {}
    # stages that are stored anyway are read back from there, not computed again
    for name, (df, partition_by) in outputs.items():
        path = os.path.join(out, name)
        write_table(df, path, partition_by=partition_by)
        written[name] = path
    audit.close()
    return written


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--csv", help="raw application CSV path or glob")
    src.add_argument("--tables", help="folder with the star-schema test tables (adapter input)")
    ap.add_argument("--out", required=True, help="output folder for the stage tables")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("lendlens-audit").getOrCreate()
    for name, path in run(spark, args.out, csv=args.csv, tables=args.tables).items():
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
