"""The composed audit: every stage table as a lazy DataFrame.

``AuditPipeline(spark, sf_dir)`` exposes one property per stage table of the
audited script (T1..T15, V1). Stages are built on first access and shared, so
one Spark plan reuses the same sub-plans (and Spark reuses their exchanges).

With ``materialize=True`` the stages that several later stages read (the
embedded applications, pairs, clusters, violations, statistics, assessment,
lender summary; not the pair evidence, which only the violation join reads)
are written once under the shared ``spark.checkpoint.dir``
folder and read back -- the batch-job mode: lineage is cut, and a lost
executor re-reads a stored table instead of recomputing the audit.
"""

from __future__ import annotations

import atexit
import os
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assess, clusters, embed, evaluate, features, layers, lenders, pairs, report, rules, stats
from ..session import ensure_checkpoint_dir
from ..sources import adapter, sinks


# Which stages each stage reads, once per read in its plan (the audit's table
# DAG): the pair self-join reads the applications on both sides, the clusters
# aggregate and join back to them, the report filters and joins the summary.
STAGE_INPUTS: dict[str, tuple[str, ...]] = {
    "cleaned": (), "features": ("cleaned",), "profiles": ("features",), "embedded": ("profiles",), "text_embedded": ("profiles",), "financial": ("embedded",),
    "pairs": ("embedded", "embedded"), "evidence": ("pairs",), "clusters": ("embedded", "embedded"),
    "violations": ("embedded", "clusters", "evidence"), "lender_stats": ("violations",),
    "statistics": ("lender_stats",), "assessment": ("violations", "statistics"), "summary": ("assessment",),
    "validation": ("summary", "statistics"), "metrics": ("validation",), "report": ("assessment", "summary", "summary"),
    "dashboard": ("embedded", "pairs", "clusters", "assessment", "summary", "statistics", "metrics", "report"),
    "layered": ("embedded", "clusters", "pairs"), "layered_violations": ("layered", "layered"),
    "roc": ("assessment", "validation", "validation", "metrics"),
    "export": ("assessment",), "run_summary": ("assessment", "pairs", "clusters"),
}
#: The way to the grid clusters, which read none of the financial columns.
CLUSTER_STAGES = {"cleaned", "features", "profiles", "embedded", "clusters"}
FINANCIAL_COLUMNS = ("financial_embedding", "income", "loan_amount", "calculated_dti_ratio", "rate_spread_adj")
STORABLE = ("embedded", "text_embedded", "financial", "pairs", "clusters", "violations", "layered", "statistics", "assessment", "summary")


def stages_needed(targets: tuple[str, ...] | list[str]) -> set[str]:
    """All stages that building ``targets`` goes through."""
    reach: set[str] = set()
    todo = list(targets)
    while todo:
        s = todo.pop()
        if s not in reach:
            reach.add(s)
            todo.extend(STAGE_INPUTS[s])
    return reach


def stages_to_store(targets: tuple[str, ...] | list[str]) -> set[str]:
    """Storable stages read more than once when building ``targets``.

    A stage read by one consumer only is cheaper to keep in the consumer's
    plan than to write and read back."""
    reach = stages_needed(targets)
    reads = {s: 0 for s in reach}
    for consumer in reach:
        for dep in STAGE_INPUTS[consumer]:
            reads[dep] += 1
    for t in targets:
        reads[t] += 1
    return {s for s in STORABLE if reads.get(s, 0) >= 2}


class AuditPipeline:
    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str | None = None,
        *,
        raw: DataFrame | None = None,
        vectors: DataFrame | None = None,
        profile_embedder=None,
        financial_embedder=None,
        grid_scale: float = clusters.GRID_SCALE,
        rule_specs: list | None = None,
        z_forms: dict | None = None,
        materialize: bool = False,
        stage_root: str | None = None,
        bucket_stages: bool = False,
        buckets: int | None = None,
        store: set[str] | None = None,
        needed: set[str] | None = None,
    ):
        if raw is None and sf_dir is None:
            raise ValueError("give sf_dir (test tables) or raw (raw-schema DataFrame)")
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw = raw
        self._vectors = vectors
        self.profile_embedder = profile_embedder
        self.financial_embedder = financial_embedder
        self.grid_scale = grid_scale
        self.rule_specs = rule_specs or rules.default_rules()
        self.z_forms = z_forms
        self.materialize = materialize
        self.store = store  # with materialize: only these stages (None: every reusable stage)
        self.needed = needed  # with store: the stages that the query goes through (None: any)
        self.stage_root = stage_root
        # Optionally store the stages joined on application_id bucketed alike
        # (co-located joins). The audit joins them on the id once, so bucketing
        # would only move that shuffle to write time; it pays off for callers
        # that join these stage tables again.
        self.bucket_stages = bucket_stages
        self.buckets = buckets if buckets is not None else int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        self._run_id = uuid.uuid4().hex[:12]
        self._own_root = False

    def _stage(self, df: DataFrame, name: str, partition_by=(), bucket_by: str | None = None,
               stage: str | None = None) -> DataFrame:
        if not self.materialize or (self.store is not None and stage not in self.store):
            return df
        # a table stored for one query is read whole: no folder a state, which would sort the rows first
        return sinks.stage_table(
            self.spark, df, name, self._root(), partition_by if self.store is None else (),
            bucket_by=bucket_by if self.bucket_stages else None,
            buckets=self.buckets if (bucket_by and self.bucket_stages) else 0, table_prefix=f"lendlens_{self._run_id}",
        )

    def stage_path(self, name: str) -> str:
        """Where this run keeps a table of its own."""
        return os.path.join(self._root(), name)

    def store_csv(self, df: DataFrame, name: str = "csv") -> str:
        """Write header-led CSV files into this run's stage folder; returns their folder."""
        path = self.stage_path(name)
        df.write.mode("overwrite").option("header", True).csv(path)
        return path

    def store_lines(self, df: DataFrame) -> str:
        """Write one text column as lines into this run's stage folder; returns their folder."""
        path = os.path.join(self._root(), "lines")
        df.write.mode("overwrite").text(path)
        return path

    def _root(self) -> str:
        """This run's folder under the shared checkpoint folder."""
        if self.stage_root is None:
            self.stage_root = os.path.join(ensure_checkpoint_dir(self.spark), "lendlens-stages", self._run_id)
            self._own_root = True
            atexit.register(self.close)
        return self.stage_root

    def close(self) -> None:
        """Remove the stage tables of this run (also done when the program ends)."""
        if self._own_root:
            try:
                sinks.remove_path(self.spark, self.stage_root)
            except Exception:  # the session has ended; the shared folder's owner cleans up
                return
            self._own_root = False

    def __enter__(self) -> AuditPipeline:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    # ---- ingest ---------------------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        return self._raw if self._raw is not None else adapter.raw_applications(self.spark, self.sf_dir)

    @cached_property
    def cleaned(self) -> DataFrame:
        # the adapter's key is a dense row id (numbering leaves rows without one out); raw CSV rows carry a content hash
        if self._raw is not None:
            return features.clean_applications(self._raw, hashed_key=True)
        raw = adapter.raw_applications(self.spark, self.sf_dir, keyed=True)
        return features.clean_applications(raw, sizes=adapter.lender_rows(self.spark, self.sf_dir))

    @cached_property
    def features(self) -> DataFrame:
        """T1."""
        return features.add_features(self.cleaned)

    @cached_property
    def profiles(self) -> DataFrame:
        """T2 (plus ``source_key`` for the vector-table embedder)."""
        return features.application_profiles(self.features, keep=["source_key"])

    @cached_property
    def embedded(self) -> DataFrame:
        """Profile + financial embeddings."""
        use_table = self.profile_embedder is None and (self._vectors is not None or self.sf_dir is not None)
        if use_table:
            vectors = self._vectors if self._vectors is not None else adapter.table_vectors(self.spark, self.sf_dir)
            # scalar copies of the vector length and lead coordinates: the grid
            # clusters then read a few doubles per row, not the whole vector
            df = embed.attach_table_vectors(
                self.profiles, vectors, scalars=lambda v: clusters.lead_columns(v, name="profile_embedding"),
                has_text=features.has_profile_text(),
            )
        else:
            df = embed.embed_applications(self.profiles, self.profile_embedder, self.financial_embedder,
                                          has_text=features.has_profile_text())
            df = df.withColumns(clusters.lead_columns("profile_embedding"))
        if self.store is not None and "embedded" in self.store:
            # stored for one query: its stages read the scalars, not the texts and vectors
            df = df.drop("profile_text", "profile_embedding")
            if self.needed is not None and "clusters" in self.needed and self.needed <= CLUSTER_STAGES:
                df = df.drop(*FINANCIAL_COLUMNS)
            elif use_table:
                # the vector is put together from four stored numbers where it is read
                df = self._stage(df.drop("financial_embedding"), "application_embeddings", stage="embedded")
                return df.withColumn("financial_embedding", embed.numeric_vector())
        return self._stage(df, "application_embeddings", bucket_by="application_id", stage="embedded")

    @cached_property
    def text_embedded(self) -> DataFrame:
        """T3 with both texts embedded by feature hashing, for the pair search: its sides, cells and vectors
        each read the applications."""
        df = embed.embed_applications(self.profiles, has_text=features.has_profile_text()).drop("profile_text", "profile_embedding")
        return self._stage(df, "text_embeddings", stage="text_embedded")

    @cached_property
    def financial(self) -> DataFrame:
        """The applications with their financial vector only: no look at the profile vectors."""
        lead = clusters.lead_columns("profile_embedding")
        return self._stage(self.embedded.drop("profile_text", "profile_embedding", *lead), "financial_embeddings", stage="financial")

    @property
    def financial_dim(self) -> int | None:
        """Known length of the financial vectors (the numeric adapter vector)."""
        uses_numeric = self.profile_embedder is None and (self._vectors is not None or self.sf_dir is not None)
        return embed.FINANCIAL_DIM if uses_numeric else None

    # ---- evidence -------------------------------------------------------------
    @cached_property
    def pairs(self) -> DataFrame:
        """T6."""
        df = pairs.similar_pairs(self.embedded, vector_dim=self.financial_dim)
        return self._stage(df, "vector_similar_pairs", stage="pairs")

    @cached_property
    def evidence(self) -> DataFrame:
        # read once (by the violation join) unless stages are bucketed for reuse
        df = rules.pair_evidence(self.pairs, self.rule_specs)
        return self._stage(df, "pair_evidence", bucket_by="application_id", stage="evidence") if self.bucket_stages else df

    @cached_property
    def clusters(self) -> DataFrame:
        """T7."""
        return self._stage(clusters.grid_clusters(self.embedded, scale=self.grid_scale), "cluster_analysis",
                           bucket_by="application_id", stage="clusters")

    @cached_property
    def violations(self) -> DataFrame:
        """T8."""
        # the two pair flags ride along so the lender statistics need no second join
        df = rules.evaluate_rules(self.embedded, self.clusters, self.evidence, self.rule_specs,
                                  carry=("has_race_pair", "has_gender_pair"))
        return self._stage(df, "rule_violations", ("state_code",), stage="violations")

    @cached_property
    def lender_stats(self) -> DataFrame:
        return stats.lender_statistics(self.violations)

    @cached_property
    def statistics(self) -> DataFrame:
        """T9."""
        return self._stage(stats.statistical_tests(self.lender_stats, self.z_forms), "statistical_analysis",
                           stage="statistics")

    # ---- roll-ups -------------------------------------------------------------
    @cached_property
    def assessment(self) -> DataFrame:
        """T10."""
        statistics = self.statistics
        if self.materialize and self.store is not None and "statistics" not in self.store:
            # one row a lender and state: where the stored table is small, the violations aren't moved to meet it
            statistics = statistics.select("lei", "state_code", *assess.STAT_COLUMNS)
            statistics = sinks.stage_table(self.spark, statistics, "lender_statistics", self._root())
        df = assess.final_assessment(self.violations, statistics)
        if not self.materialize or self.store is None or "assessment" not in self.store:
            return self._stage(df, "final_assessment", ("state_code",), stage="assessment")
        # stored for one query: the explanation is put together where it is read
        stored = self._stage(df.drop("ai_enhanced_explanation"), "final_assessment", stage="assessment")
        return stored.withColumn("ai_enhanced_explanation", assess.explanation()).select(*df.columns)

    @cached_property
    def summary(self) -> DataFrame:
        """T11."""
        return self._stage(lenders.lender_risk_summary(self.assessment), "lender_risk_summary", stage="summary")

    @cached_property
    def validation(self) -> DataFrame:
        """T12."""
        return evaluate.validation(self.summary, self.statistics)

    @cached_property
    def metrics(self) -> DataFrame:
        """T13."""
        return evaluate.performance_metrics(self.validation)

    @cached_property
    def layered_violations(self) -> DataFrame:
        """T8 with R002 and R009, which the published script documents but never evaluates."""
        specs = self.rule_specs if any(r.reads for r in self.rule_specs) else layers.layered_rules()
        return layers.evaluate_layers(
            self.embedded, self.clusters, self.pairs, specs,
            statistics=lambda v: stats.statistical_tests(stats.lender_statistics(v), self.z_forms),
            store=lambda v: self._stage(v, "layered_violations", stage="layered"),
        )

    @cached_property
    def roc(self) -> DataFrame:
        """Areas under the ROC curve of the risk scores against T12's truth, for applications and
        for lender/states, next to the published balanced accuracy."""
        truth = self.validation.select("lei", "state_code", "ai_verified_discriminatory_lender", "avg_ai_mln_risk_score")
        apps = self.assessment.select("lei", "state_code", "ai_enhanced_mln_risk_score").join(truth, ["lei", "state_code"])
        target = "ai_verified_discriminatory_lender"
        areas = evaluate.roc_area(apps, "ai_enhanced_mln_risk_score", target).withColumn("level", F.lit("application")).unionByName(
            evaluate.roc_area(truth, "avg_ai_mln_risk_score", target).withColumn("level", F.lit("lender")))
        balanced = self.metrics.select("ai_auc_approximation").scalar()
        return areas.withColumn("balanced_accuracy", balanced)

    def report(self, nested_samples: bool = True, as_of=None, ordered: bool = False) -> DataFrame:
        """T14 (``ordered``: tier 1 before 2, then mean risk descending)."""
        df = report.compliance_report(self.assessment, self.summary, nested_samples=nested_samples, as_of=as_of)
        return lenders.tier_order(df) if ordered else df

    def dashboard(self, ordered: bool = False) -> DataFrame:
        """T15 (``ordered``: by section header, then metric name)."""
        df = report.dashboard(
            self.spark, embedded=self.embedded, pairs=self.pairs, clusters=self.clusters,
            assessment=self.assessment, summary=self.summary, statistics=self.statistics,
            metrics=self.metrics, report=self.report(nested_samples=False),
        )
        return df.orderBy("section_header", "metric_name") if ordered else df

    def export(self, as_of=None, with_metadata: bool = True, view_name: str | None = None) -> DataFrame:
        """V1 (``view_name``: also register it as a temporary view)."""
        df = report.export_view(self.assessment, as_of=as_of, with_metadata=with_metadata)
        return sinks.create_view(df, view_name) if view_name else df

    def run_summary(self, with_timestamp: bool = True) -> DataFrame:
        return report.run_summary(self.assessment, self.pairs, self.clusters, with_timestamp=with_timestamp)

    def rules_table(self) -> DataFrame:
        return rules.rules_table(self.spark, self.rule_specs)

    def finance_table(self, path: str | None = None) -> DataFrame:
        """T4: the embeddings table without the profile vector (``* EXCEPT``).
        With ``path``, stored create-only (fails if the table exists)."""
        df = self.embedded.drop("profile_embedding")
        if path is not None:
            sinks.create_table(df, path, partition_by=("state_code",))
            return self.spark.read.parquet(path)
        return df
