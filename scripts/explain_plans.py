"""Print the physical plans of the audit's heavy operators and a few markers.

Usage: python scripts/explain_plans.py [sf_dir] [--no-broadcast]
For each operator: counts of exchanges, join strategies, WindowGroupLimit,
Cartesian / nested-loop joins, and the scans' pushed filters / read schema.
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from lendlens.operators import clusters as C  # noqa: E402
from lendlens.operators import pairs as P  # noqa: E402
from lendlens.operators import report as R  # noqa: E402
from lendlens.operators import rules as RU  # noqa: E402
from lendlens.plans import AuditPipeline  # noqa: E402
from lendlens.session import local_session  # noqa: E402

MARKERS = ["Exchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "WindowGroupLimit",
           "CartesianProduct", "BroadcastNestedLoopJoin", "HashAggregate", "Window "]


def main() -> None:
    args = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(8)
    if "--no-broadcast" in sys.argv:  # the regime of a large run: every join shuffles
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    p = AuditPipeline(spark, sf_dir, materialize=True)
    # each operator is planned on its stored inputs, as a registered query runs it
    ops = {
        "similar_pairs": P.similar_pairs(p.embedded, vector_dim=p.financial_dim),
        "grid_clusters": C.grid_clusters(p.embedded),
        "rule_violations": RU.evaluate_rules(p.embedded, p.clusters, p.evidence),
        "lender_statistics": p.lender_stats,
        "flagged_samples": R.flagged_samples(p.assessment, p.summary),
        "raw_applications": p.raw,
    }
    for name, df in ops.items():
        qe = df._jdf.queryExecution()
        plan = qe.executedPlan().toString()
        print(f"===== {name}")
        print("   " + ", ".join(f"{m.strip()}={plan.count(m)}" for m in MARKERS))
        for line in plan.splitlines():
            s = line.strip()
            if "FileScan" in s or "Scan parquet" in s:
                for key in ("PushedFilters", "ReadSchema"):
                    if key in s:
                        part = s[s.index(key):]
                        print("   " + part[:220])
    spark.stop()


if __name__ == "__main__":
    main()
