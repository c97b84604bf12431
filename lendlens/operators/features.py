"""Cleaning, labelling and feature engineering of raw applications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import band, dlit, ieee_divide, label_map, num_text
from .ids import application_ids

# ---- fixed values of the audit (codes, labels, band bounds, sentinels) -------
AUDIT_STATES = ("CA", "FL", "MI", "NY", "WA")
VALID_ETHNICITY = (1, 2, 3)
VALID_RACE = (1, 2, 3, 4, 5)
VALID_SEX = (1, 2, 3, 4)
VALID_ACTIONS = (1, 2, 3, 4, 5)
SENTINELS = ("NA", "EXEMPT")
RACE_LABELS = {5: "White", 3: "Black", 2: "Asian", 1: "American Indian", 4: "Hawaiian_Pacific"}
RACE_OTHER = "Other"
ETHNICITY_LABELS = {1: "Hispanic", 2: "Not_Hispanic"}
SEX_LABELS = {1: "Male", 2: "Female"}
NOT_PROVIDED = "Not Provided"
INCOME_BANDS = [(150, "High_Income"), (80, "Medium_Income"), (50, "Low_Medium_income")]
INCOME_DEFAULT = "Low_Income"
MINORITY_BANDS = [(50, "High_Minority_Area"), (20, "Medium_Minority_Area")]
MINORITY_DEFAULT = "Low_Minority_Area"
TRACT_INCOME_BANDS = [(120, "Above_Area_Median"), (80, "Near_Area_Median")]
TRACT_INCOME_DEFAULT = "Below_Area_Median"
# -------------------------------------------------------------------------------


def clean_applications(
    raw: DataFrame,
    states: Sequence[str] = AUDIT_STATES,
    order_key: str = "source_key",
    chunk_width: int = 4096,
    hashed_key: bool = False,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """State filter, validation with NULL-on-invalid, surrogate id.

    ``hashed_key=True`` when ``order_key`` is a content hash (CSV input) rather
    than a dense row id; ``sizes`` bounds the lenders' rows (see :func:`lendlens.operators.ids.number_within`).
    """
    cleaned = clean_rows(raw, states, order_key)
    return application_ids(cleaned, order_key=order_key, chunk_width=chunk_width, hashed_key=hashed_key, sizes=sizes)


def clean_rows(raw: DataFrame, states: Sequence[str] = AUDIT_STATES, order_key: str = "source_key") -> DataFrame:
    """The valid rows without an id yet.

    Sentinel checks are case-sensitive where the audit's are (``rate_spread``
    row filter), case-insensitive where it upper-cases; numbers that still do
    not parse become NULL (``try_cast``) instead of failing the job.
    """
    kept = raw.where(F.col("state_code").isin(*states)).where(
        F.col("action_taken").isin(*VALID_ACTIONS)
        & F.col("loan_amount").isNotNull()
        & F.col("applicant_race_1").isNotNull()
        & F.col("applicant_ethnicity_1").isNotNull()
        & F.col("applicant_sex").isNotNull()
        & ~F.col("rate_spread").isin(*SENTINELS)
    )
    income_ok = ~F.col("income").isin(*SENTINELS) & F.col("income").isNotNull()
    spread_ok = ~F.upper(F.col("rate_spread")).isin(*SENTINELS)
    return kept.select(
        "lei", "activity_year", "state_code", "county_code", "census_tract",
        F.when(F.col("applicant_ethnicity_1").isin(*VALID_ETHNICITY), F.col("applicant_ethnicity_1")).alias("applicant_ethnicity_1"),
        F.when(F.col("applicant_race_1").isin(*VALID_RACE), F.col("applicant_race_1")).alias("applicant_race_1"),
        F.when(F.col("applicant_sex").isin(*VALID_SEX), F.col("applicant_sex")).alias("applicant_sex"),
        "applicant_age",
        F.when(income_ok, F.col("income").try_cast("double")).alias("income"),
        "loan_amount",
        F.when(spread_ok, F.col("rate_spread").try_cast("double")).alias("rate_spread"),
        F.when(~F.col("debt_to_income_ratio").isin(*SENTINELS), F.col("debt_to_income_ratio")).alias("debt_to_income_ratio"),
        "loan_type", "loan_purpose", "occupancy_type",
        F.col("derived_dwelling_category").alias("property_type"),
        "derived_loan_product_type", "lien_status",
        F.col("tract_population").alias("population"),
        F.col("tract_minority_population_percent").alias("minority_population_percent"),
        F.col("ffiec_msa_md_median_family_income").alias("ffiec_median_family_income"),
        "tract_to_msa_income_percentage",
        "action_taken", "denial_reason_1", "denial_reason_2", "denial_reason_3",
        order_key,
    )


def amortized_dti(
    income: Column,
    loan_amount: Column,
    rate_spread: Column,
    base_rate: float = 6.0,
    months: int = 360,
    loan_unit: float = 1000.0,
) -> Column:
    """Yearly payment of an amortised loan over yearly income.

    ``c = (spread + base_rate)/100/12``; payment ``L*c(1+c)^n/((1+c)^n - 1)``;
    ratio ``payment * 12 / income`` with both money amounts in ``loan_unit``.
    NULL when income is NULL or the loan is not positive; IEEE semantics for
    a zero income (infinity).
    """
    c = (F.coalesce(rate_spread, dlit(0.0)) + dlit(base_rate)) / dlit(100.0) / dlit(12.0)
    growth = F.pow(dlit(1.0) + c, dlit(months))
    value = (
        (loan_amount * dlit(loan_unit))
        * (c * growth)
        * ieee_divide(dlit(1.0), growth - dlit(1.0))
    ) * ieee_divide(dlit(12.0), income * dlit(loan_unit))
    return F.when(income.isNotNull() & (loan_amount.cast("double") > 0), value)


def race_category(code: Column) -> Column:
    return label_map(code, RACE_LABELS, RACE_OTHER)


def ethnicity_category(code: Column) -> Column:
    return label_map(code, ETHNICITY_LABELS, NOT_PROVIDED)


def gender_category(code: Column) -> Column:
    return label_map(code, SEX_LABELS, NOT_PROVIDED)


def add_features(cleaned: DataFrame, base_rate: float = 6.0, months: int = 360, loan_unit: float = 1000.0) -> DataFrame:
    """Labels, bands, amortised DTI, outcome flag, completeness filter.

    The audit's ``SELECT DISTINCT *`` is dropped: every row already carries a
    unique surrogate id, so it would be a full shuffle that removes nothing.
    """
    inc = F.col("income")
    return cleaned.withColumns(
        {
            "race_category": race_category(F.col("applicant_race_1")),
            "ethnicity_category": ethnicity_category(F.col("applicant_ethnicity_1")),
            "gender_category": gender_category(F.col("applicant_sex")),
            "income_category": band(inc, INCOME_BANDS, INCOME_DEFAULT),
            "calculated_dti_ratio": amortized_dti(inc, F.col("loan_amount"), F.col("rate_spread"), base_rate, months, loan_unit),
            "area_minority_concentration": band(F.col("minority_population_percent"), MINORITY_BANDS, MINORITY_DEFAULT),
            "relative_area_income": band(F.col("tract_to_msa_income_percentage"), TRACT_INCOME_BANDS, TRACT_INCOME_DEFAULT),
            "approved": F.coalesce(F.col("action_taken") == 1, F.lit(False)),
        }
    ).where(inc.isNotNull() & F.col("loan_amount").isNotNull() & F.col("calculated_dti_ratio").isNotNull())


# ---- fixed values: profile and financial text templates ----------------------
def profile_text() -> Column:
    """The application described as one sentence block."""
    c = F.col
    spread = F.when(c("rate_spread").isNotNull(), F.concat(F.lit("Rate spread: "), num_text(c("rate_spread")), F.lit(". "))).otherwise(F.lit("Prime rate loan. "))
    denial = F.when(~c("approved") & c("denial_reason_1").isNotNull(), F.concat(F.lit(" (Denial reason: "), c("denial_reason_1").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("Mortgage application for "), c("race_category"), F.lit(" "), c("ethnicity_category"), F.lit(" "), c("gender_category"), F.lit(" applicant. "),
        F.lit("Income level: "), c("income_category"), F.lit(" ($"), num_text(c("income"), 0), F.lit("K). "),
        F.lit("Loan amount: $"), num_text(c("loan_amount"), 0), F.lit("K. "),
        F.lit("DTI ratio: "), num_text(c("calculated_dti_ratio"), 3), F.lit(". "),
        F.lit("Geographic area: "), c("area_minority_concentration"), F.lit(", "), c("relative_area_income"), F.lit(". "),
        F.lit("Loan type: "), c("loan_type").cast("string"), F.lit(", purpose: "), c("loan_purpose").cast("string"), F.lit(". "),
        F.lit("Property type: "), c("property_type").cast("string"), F.lit(", occupancy: "), c("occupancy_type").cast("string"), F.lit(". "),
        spread,
        F.lit("Application outcome: "), F.when(c("approved"), F.lit("APPROVED")).otherwise(F.lit("DENIED")),
        denial,
    )


#: The columns that D9 puts together; it is null where one of them is, and never blank.
PROFILE_TEXT_PARTS = (
    "race_category", "ethnicity_category", "gender_category", "income_category", "income", "loan_amount",
    "calculated_dti_ratio", "area_minority_concentration", "relative_area_income", "loan_type", "loan_purpose",
    "property_type", "occupancy_type",
)


def has_profile_text() -> Column:
    """Whether D9's text is there, without putting it together."""
    there = F.lit(True)
    for part in PROFILE_TEXT_PARTS:
        there = there & F.col(part).isNotNull()
    return there


def financial_text() -> Column:
    """The four financial numbers as text."""
    c = F.col
    return F.concat(
        F.lit("Financial profile: Income $"), num_text(F.coalesce(c("income"), dlit(0)), 0), F.lit("K, "),
        F.lit("Loan $"), num_text(F.coalesce(c("loan_amount"), dlit(0)), 0), F.lit("K, "),
        F.lit("DTI "), num_text(F.coalesce(c("calculated_dti_ratio"), dlit(0)), 3), F.lit(", "),
        F.lit("Rate spread "), num_text(F.coalesce(c("rate_spread_adj"), dlit(0))),
    )
# -------------------------------------------------------------------------------


PROFILE_COLUMNS = [
    "application_id", "lei", "state_code", "approved", "profile_text",
    "race_category", "ethnicity_category", "gender_category", "income_category",
    "income", "loan_amount", "calculated_dti_ratio", "area_minority_concentration",
    "relative_area_income", "rate_spread_adj", "loan_type", "loan_purpose",
    "property_type", "occupancy_type",
]


def application_profiles(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Profile text plus the analysis columns; rows with a NULL id dropped."""
    return (
        features.where(F.col("application_id").isNotNull())
        .withColumn("profile_text", profile_text())
        .withColumn("rate_spread_adj", F.coalesce(F.col("rate_spread"), dlit(0.0)))
        .select(*PROFILE_COLUMNS, *keep)
    )


def financial_texts(profiles: DataFrame) -> DataFrame:
    """Financial text per application; rows missing a number get none."""
    ok = (
        F.col("income").isNotNull() & F.col("loan_amount").isNotNull()
        & F.col("calculated_dti_ratio").isNotNull() & F.col("rate_spread_adj").isNotNull()
    )
    return profiles.where(ok).select("application_id", financial_text().alias("financial_text"))
