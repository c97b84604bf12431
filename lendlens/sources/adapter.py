"""Adapter: raw application records derived from the star-schema test tables.

The audited input (a public loan-application register CSV) is not available
offline, so one application is derived per ``orders`` row, joined to its
customer and nation. Every attribute is a deterministic function of
``md5(o_orderkey || salt)`` so another engine can recompute it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import md5_unit
from .raw import RAW_COLUMNS, SOURCE_KEY
from .tables import read_table, spread

# ---- fixed values of the adapter (shared with the SQL oracle) ---------------
STATE_BY_REGION = ["CA", "FL", "MI", "NY", "WA"]
AGE_BUCKETS = ["<25", "25-34", "35-44", "45-54", "55-64", "65-74", ">74", "NA"]
DTI_BUCKETS = ["<20%", "20%-<30%", "30%-<36%", "36", "40", "45", "50%-60%", ">60%", "NA", "Exempt"]
DWELLING_CATEGORIES = [
    "Single Family (1-4 Units):Site-Built",
    "Single Family (1-4 Units):Manufactured",
    "Multifamily:Site-Built",
    "Multifamily:Manufactured",
]
LOAN_PRODUCTS = [
    "Conventional:First Lien",
    "FHA:First Lien",
    "VA:First Lien",
    "FSA/RHS:First Lien",
    "Conventional:Subordinate Lien",
    "FHA:Subordinate Lien",
]
LENDERS_PER_SUPPLIERS = 5  # lenders = count(supplier) div 5
UNITS = "race eth sex inc rs act ag db lt lp oc dw pr ls tp min mi ti dr".split()
FILTER_UNITS = "race act inc rs".split()
#: Rate spreads from -1.00 to 2.99 as texts of two digits (an order without a key has the text "null").
RATE_SPREADS = [f"{(n - 100) / 100:.2f}" for n in range(400)]
# ------------------------------------------------------------------------------


def _pick(values: list[str], u) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (u % len(values) + 1).cast("int"))


def _lender_count(spark: SparkSession, sf_dir: str) -> F.Column:
    return (
        read_table(spark, sf_dir, "supplier")
        .select(F.greatest(F.floor(F.count("*") / LENDERS_PER_SUPPLIERS), F.lit(1)).cast("bigint"))
        .scalar()
    )


def _lender(n_lenders: F.Column) -> F.Column:
    return F.concat(F.lit("LEI"), F.lpad((F.col("o_custkey") % n_lenders).cast("string"), 4, "0")).alias("lei")


def lender_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lei`` of every order: what bounds a lender's applications, told from two columns of one table."""
    return read_table(spark, sf_dir, "orders").select(_lender(_lender_count(spark, sf_dir)))


def raw_applications(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """Raw-schema rows (plus ``source_key``) for every order of ``sf_dir``; ``keyed``: only those with a key.

    Where the key is known, the loan's type, purpose, property and occupancy are known too, and are declared so:
    a reader that only asks whether they are there doesn't compute them."""
    orders = spread(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    if keyed:
        orders = orders.where(F.col("o_orderkey").isNotNull())

    def known(value: F.Column, other) -> F.Column:
        return F.coalesce(value, F.lit(other)) if keyed else value

    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation has a fixed 25 rows: a proven-small broadcast side.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    df = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    k = F.col("o_orderkey")
    # every unit is one column, computed once a row, that the branches below refer to; those that row
    # filters read are generated, or the filters would move below and compute them anew in each branch
    df = df.withColumns({f"_u_{salt}": md5_unit(k, salt) for salt in UNITS if salt not in FILTER_UNITS})
    df = df.select("*", F.inline(F.array(F.struct(*(md5_unit(k, salt).alias(f"_u_{salt}") for salt in FILTER_UNITS)))))

    def u(salt: str):
        return F.col(f"_u_{salt}")

    race_u = u("race")
    race = (
        F.when(race_u < 500, 5).when(race_u < 750, 3).when(race_u < 880, 2)
        .when(race_u < 910, 1).when(race_u < 930, 4).otherwise(6)
    )
    eth_u = u("eth")
    ethnicity = F.when(eth_u < 250, 1).when(eth_u < 950, 2).otherwise(3)
    sex_u = u("sex")
    sex = F.when(sex_u < 480, 2).when(sex_u < 970, 1).otherwise(3)
    inc_u = u("inc")
    income = (
        F.when(inc_u < 20, F.lit("NA")).when(inc_u < 30, F.lit("Exempt"))
        .otherwise((F.lit(30) + F.floor(inc_u / 5)).cast("bigint").cast("string"))
    )
    rs_u = u("rs")
    rate_spread = (
        F.when(rs_u < 30, F.lit("NA")).when(rs_u < 50, F.lit("Exempt"))
        .otherwise(F.coalesce(F.get(F.array(*[F.lit(v) for v in RATE_SPREADS]), (rs_u % 400).cast("int")), F.lit("null")))
    )
    act_u = u("act")
    approve_below = F.when(race == 5, 850).when(race == 3, 520).otherwise(780)
    action = F.when(act_u < approve_below, 1).when(act_u < 960, 3).when(act_u < 980, 4).otherwise(6)

    out = df.select(
        _lender(_lender_count(spark, sf_dir)),
        F.lit(2024).alias("activity_year"),
        _pick(STATE_BY_REGION, F.col("n_regionkey")).alias("state_code"),
        F.col("n_nationkey").cast("string").alias("county_code"),
        F.col("c_custkey").cast("string").alias("census_tract"),
        ethnicity.alias("applicant_ethnicity_1"),
        race.alias("applicant_race_1"),
        sex.alias("applicant_sex"),
        _pick(AGE_BUCKETS, u("ag")).alias("applicant_age"),
        income.alias("income"),
        (F.col("o_totalprice") / 1000.0).alias("loan_amount"),
        rate_spread.alias("rate_spread"),
        _pick(DTI_BUCKETS, u("db")).alias("debt_to_income_ratio"),
        known((1 + u("lt") % 4).cast("int"), 0).alias("loan_type"),
        known((1 + u("lp") % 5).cast("int"), 0).alias("loan_purpose"),
        known((1 + u("oc") % 3).cast("int"), 0).alias("occupancy_type"),
        known(_pick(DWELLING_CATEGORIES, u("dw")), "").alias("derived_dwelling_category"),
        _pick(LOAN_PRODUCTS, u("pr")).alias("derived_loan_product_type"),
        (1 + u("ls") % 2).cast("int").alias("lien_status"),
        (1000 + u("tp") * 5).cast("int").alias("tract_population"),
        (u("min").cast("double") / 10.0).alias("tract_minority_population_percent"),
        (60000 + u("mi") * 80).cast("double").alias("ffiec_msa_md_median_family_income"),
        (50 + u("ti") % 100).cast("double").alias("tract_to_msa_income_percentage"),
        action.cast("int").alias("action_taken"),
        F.when(action == 3, 1 + u("dr") % 9).cast("int").alias("denial_reason_1"),
        F.lit(None).cast("int").alias("denial_reason_2"),
        F.lit(None).cast("int").alias("denial_reason_3"),
        k.alias(SOURCE_KEY),
    )
    return out.select(*RAW_COLUMNS, SOURCE_KEY)


def table_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``embeddings`` table as ``(vec_id, vector array<double>)``."""
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector")
    )
