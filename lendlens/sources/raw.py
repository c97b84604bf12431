"""Raw application records: explicit schema and the CSV scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the public loan-application register file that the audit reads.
# Numeric-looking fields that carry text sentinels ('NA', 'Exempt') stay STRING.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("lei", T.StringType()),
        T.StructField("activity_year", T.IntegerType()),
        T.StructField("state_code", T.StringType()),
        T.StructField("county_code", T.StringType()),
        T.StructField("census_tract", T.StringType()),
        T.StructField("applicant_ethnicity_1", T.IntegerType()),
        T.StructField("applicant_race_1", T.IntegerType()),
        T.StructField("applicant_sex", T.IntegerType()),
        T.StructField("applicant_age", T.StringType()),
        T.StructField("income", T.StringType()),
        T.StructField("loan_amount", T.DoubleType()),
        T.StructField("rate_spread", T.StringType()),
        T.StructField("debt_to_income_ratio", T.StringType()),
        T.StructField("loan_type", T.IntegerType()),
        T.StructField("loan_purpose", T.IntegerType()),
        T.StructField("occupancy_type", T.IntegerType()),
        T.StructField("derived_dwelling_category", T.StringType()),
        T.StructField("derived_loan_product_type", T.StringType()),
        T.StructField("lien_status", T.IntegerType()),
        T.StructField("tract_population", T.IntegerType()),
        T.StructField("tract_minority_population_percent", T.DoubleType()),
        T.StructField("ffiec_msa_md_median_family_income", T.DoubleType()),
        T.StructField("tract_to_msa_income_percentage", T.DoubleType()),
        T.StructField("action_taken", T.IntegerType()),
        T.StructField("denial_reason_1", T.IntegerType()),
        T.StructField("denial_reason_2", T.IntegerType()),
        T.StructField("denial_reason_3", T.IntegerType()),
    ]
)

RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]

# Name of the column that orders rows inside a lender when surrogate ids are drawn.
SOURCE_KEY = "source_key"


def read_raw_csv(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """Scan header-led CSV files with the explicit :data:`RAW_SCHEMA`.

    The file carries no row key, so a deterministic ``source_key`` is derived
    from the row content (stands in for the random order the original id used).
    Unparseable numeric cells become NULL (PERMISSIVE mode), as sentinels do;
    :func:`scan_raw_csv` rejects and counts such records instead.
    """
    df = (
        spark.read.schema(RAW_SCHEMA)
        .option("header", header)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return with_content_key(df)


#: Why a record was rejected: another number of fields, or a field that isn't of its type.
BAD_COLUMNS, BAD_VALUE = "columns", "value"


def scan_raw_csv(spark: SparkSession, path: str | list[str], sep: str = ",", header: bool = True,
                 mode: str = "divert") -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: the scan that accounts for every record.

    A record with too few or too many fields, or with a field that isn't of its column's type, is rejected.
    ``rejected`` holds ``file``, ``reason`` (:data:`BAD_COLUMNS` or :data:`BAD_VALUE`) and ``record``, the text as
    it stands in the file. ``mode="divert"`` leaves such records out of ``accepted``; ``mode="fail"`` makes any
    action on ``accepted`` that meets one fail and name it. An empty file gives no rows in either.
    """
    if mode not in ("divert", "fail"):
        raise ValueError("mode is divert or fail")
    df = (
        spark.read.schema(T.StructType([*RAW_SCHEMA.fields, T.StructField("_record", T.StringType())]))
        .option("header", header)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_record")
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    # always true, but it refers to every column: a scan pruned to some would not see faults in the others
    df = df.where(F.pmod(F.xxhash64(*RAW_COLUMNS), F.lit(1)) == 0)
    bad = F.col("_record").isNotNull()
    # parsed again as plain text, only a wrong number of fields is an error
    text = ", ".join(f"`{c}` string" for c in RAW_COLUMNS) + ", _short string"
    again = F.from_csv("_record", text, {"sep": sep, "columnNameOfCorruptRecord": "_short"})
    rejected = df.where(bad).select(
        F.col("_file").alias("file"),
        F.when(again["_short"].isNotNull(), BAD_COLUMNS).otherwise(BAD_VALUE).alias("reason"),
        F.col("_record").alias("record"),
    )
    if mode == "fail":
        stop = F.raise_error(F.concat(F.lit("bad record in "), "_file", F.lit(": "), "_record"))
        kept = df.where(F.when(bad, stop.cast("boolean")).otherwise(True))
    else:
        kept = df.where(~bad)
    return with_content_key(kept.select(*RAW_COLUMNS)), rejected


def reject_counts(accepted: DataFrame, rejected: DataFrame, per_file: bool = False) -> DataFrame:
    """``[file,] reason, n_rows`` of the rejected records; without ``per_file`` also the accepted ones."""
    if per_file:
        return rejected.groupBy("file", "reason").agg(F.count("*").alias("n_rows"))
    counts = rejected.groupBy("reason").agg(F.count("*").alias("n_rows"))
    return counts.unionByName(accepted.agg(F.count("*").alias("n_rows")).select(F.lit("accepted").alias("reason"), "n_rows"))


def with_content_key(df: DataFrame) -> DataFrame:
    """Add ``source_key`` = 64-bit hash of every raw column."""
    return df.withColumn(SOURCE_KEY, F.xxhash64(*[F.col(c) for c in RAW_COLUMNS]))
