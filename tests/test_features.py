"""Cleaning and features on hand-made raw rows (sentinels, invalid codes, edges)."""

import os

from pyspark.sql import functions as F

from lendlens.operators import features as FE
from lendlens.operators.ids import number_within
from lendlens.sources.raw import RAW_COLUMNS, read_raw_csv

HEADER = ",".join(RAW_COLUMNS)


def raw_line(**over):
    base = dict(
        lei="L1", activity_year="2024", state_code="CA", county_code="1", census_tract="2",
        applicant_ethnicity_1="2", applicant_race_1="5", applicant_sex="1", applicant_age="35-44",
        income="100", loan_amount="200", rate_spread="0.5", debt_to_income_ratio="36", loan_type="1",
        loan_purpose="1", occupancy_type="1", derived_dwelling_category="Single Family (1-4 Units):Site-Built",
        derived_loan_product_type="Conventional:First Lien", lien_status="1", tract_population="1000",
        tract_minority_population_percent="55.0", ffiec_msa_md_median_family_income="90000",
        tract_to_msa_income_percentage="120", action_taken="1", denial_reason_1="", denial_reason_2="",
        denial_reason_3="",
    )
    base.update(over)
    return ",".join(base[c] for c in RAW_COLUMNS)


def write_csv(tmp_path, lines):
    path = os.path.join(tmp_path, "raw.csv")
    with open(path, "w") as fh:
        fh.write(HEADER + "\n" + "\n".join(lines) + "\n")
    return path


def test_clean_and_features_edges(spark, tmp_path):
    lines = [
        raw_line(census_tract="a"),                                  # kept, approved
        raw_line(census_tract="b", income="NA"),                      # income NULL -> dropped at the end
        raw_line(census_tract="c", income="Exempt"),                  # not a listed sentinel; unparseable -> NULL
        raw_line(census_tract="d", rate_spread="NA"),                 # row filtered (case-sensitive sentinel)
        raw_line(census_tract="e", rate_spread="Exempt"),             # kept, spread NULL (upper-cased check)
        raw_line(census_tract="f", rate_spread=""),                   # NULL spread -> NOT IN is NULL -> dropped
        raw_line(census_tract="g", applicant_race_1="6"),             # invalid code -> NULL -> 'Other'
        raw_line(census_tract="h", applicant_ethnicity_1="14"),       # invalid -> 'Not Provided'
        raw_line(census_tract="i", action_taken="6"),                 # filtered
        raw_line(census_tract="j", state_code="TX"),                  # filtered
        raw_line(census_tract="k", income="0"),                       # DTI infinite, kept
        raw_line(census_tract="l", loan_amount="0"),                  # DTI NULL -> dropped
        raw_line(census_tract="m", action_taken="3", denial_reason_1="4"),
    ]
    raw = read_raw_csv(spark, write_csv(str(tmp_path), lines))
    cleaned = FE.clean_applications(raw)
    assert cleaned.count() == 9
    feats = {r.census_tract: r for r in FE.add_features(cleaned).collect()}
    assert set(feats) == {"a", "e", "g", "h", "k", "m"}
    a = feats["a"]
    assert (a.race_category, a.ethnicity_category, a.gender_category) == ("White", "Not_Hispanic", "Male")
    assert a.income_category == "Medium_Income" and a.area_minority_concentration == "High_Minority_Area"
    assert a.relative_area_income == "Above_Area_Median" and a.approved is True
    assert feats["e"].rate_spread is None
    assert feats["g"].race_category == "Other" and feats["h"].ethnicity_category == "Not Provided"
    assert feats["k"].calculated_dti_ratio == float("inf")
    assert feats["m"].approved is False
    ids = [r.application_id for r in cleaned.collect()]
    assert len(set(ids)) == len(ids) and all(i.startswith("L1_2024_") for i in ids)


def test_amortized_dti_value(spark):
    df = spark.createDataFrame([(100.0, 200.0, 0.0)], "income double, loan double, rs double")
    got = df.select(FE.amortized_dti(F.col("income"), F.col("loan"), F.col("rs")).alias("d")).first().d
    c = 0.06 / 12
    payment = 200000 * c * (1 + c) ** 360 / ((1 + c) ** 360 - 1)
    assert abs(got - payment * 12 / 100000) < 1e-12


def test_profile_text_template(spark, tmp_path):
    raw = read_raw_csv(spark, write_csv(str(tmp_path), [raw_line(action_taken="3", denial_reason_1="4")]))
    prof = FE.application_profiles(FE.add_features(FE.clean_applications(raw))).first()
    assert prof.profile_text.startswith("Mortgage application for White Not_Hispanic Male applicant. Income level: Medium_Income ($100K). Loan amount: $200K. DTI ratio: ")
    assert prof.profile_text.endswith("Rate spread: 0.5. Application outcome: DENIED (Denial reason: 4)")


def test_number_within_equals_window(spark):
    from pyspark.sql import Window

    df = spark.range(0, 5000).select(
        (F.col("id") % 7).cast("string").alias("g"), ((F.col("id") * 7919) % 100003).alias("k")
    )
    got = number_within(df, "g", "k", "n", chunk_width=64)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.select("g", "k", "n").exceptAll(want.select("g", "k", "n")).count() == 0
    assert got.count() == 5000


def test_number_within_hashed_key(spark):
    from pyspark.sql import Window

    df = spark.range(0, 3000).select((F.col("id") % 3).cast("string").alias("g"), F.xxhash64("id").alias("k"))
    got = number_within(df, "g", "k", "n", hashed_key=True, hashed_chunk_bits=6)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.select("g", "k", "n").exceptAll(want.select("g", "k", "n")).count() == 0


def test_identical_rows_get_different_ids(spark, tmp_path):
    lines = [raw_line(census_tract=str(i % 3), lei="L1") for i in range(30)]
    raw = read_raw_csv(spark, write_csv(str(tmp_path), lines))
    ids = {r.application_id for r in FE.clean_applications(raw, hashed_key=True).collect()}
    assert ids == {f"L1_2024_{n}" for n in range(1, 31)}


def test_offsets_over_many_runs_of_chunks(spark, monkeypatch):
    from pyspark.sql import Window

    from lendlens.operators import ids

    monkeypatch.setattr(ids, "CHUNKS_PER_RUN", 3)
    df = spark.range(500).select((F.col("id") % 2).alias("g"), (F.col("id") * 7).alias("k"))
    got = number_within(df, "g", "k", "n", chunk_width=20)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    assert got.select("g", "k", "n").exceptAll(want.select("g", "k", "n")).count() == 0
