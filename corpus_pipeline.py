"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination and
token encoding, each stage on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendlens.llm import common, decontam, line_dedup, minhash, quality, sp_codec

#: (name, function): each takes (spark, docs, sf_dir) and returns a DataFrame, which is
#: written as Parquet and read again as the next one's docs.
STAGES = [
    ("quality_rules", quality.keep_good),
    ("line_dedup", line_dedup.without_repeats),
    ("near_dedup", minhash.first_of_each),
    ("decontamination", decontam.without_contaminated),
    ("sentencepiece", sp_codec.encode_documents),
]

#: The robust estimates, sketches and token merges of the stages have no SQL form;
#: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = common.stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
