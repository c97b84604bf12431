"""Similarity pairs: the cell equi-join equals a brute-force band join; properties."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendlens.operators import pairs as P

SCHEMA = T.StructType([
    T.StructField("application_id", T.StringType()), T.StructField("lei", T.StringType()),
    T.StructField("state_code", T.StringType()), T.StructField("race_category", T.StringType()),
    T.StructField("gender_category", T.StringType()), T.StructField("ethnicity_category", T.StringType()),
    T.StructField("approved", T.BooleanType()), T.StructField("income", T.DoubleType()),
    T.StructField("loan_amount", T.DoubleType()), T.StructField("calculated_dti_ratio", T.DoubleType()),
    T.StructField("financial_embedding", T.ArrayType(T.DoubleType())),
])


def synthetic(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        inc = rnd.choice([50.0, 52.0, 55.0, 60.0, 100.0, 104.0, 110.0, 200.0]) * rnd.uniform(0.97, 1.03)
        loan = rnd.choice([100.0, 105.0, 300.0, 320.0]) * rnd.uniform(0.97, 1.03)
        dti = rnd.choice([0.2, 0.22, 0.25, 0.4]) + rnd.uniform(-0.03, 0.03)
        rows.append((
            f"A{i:04d}", f"L{i % 3}", "CA" if i % 2 else "NY", rnd.choice(["White", "Black", "Asian"]),
            rnd.choice(["Male", "Female"]), rnd.choice(["Hispanic", "Not_Hispanic"]), rnd.random() < 0.6,
            inc, loan, dti, [inc / 200, loan / 500, dti, rnd.uniform(0, 1)],
        ))
    # exact edges: equal values, ratio boundaries, a non-finite DTI
    rows.append(("Z0001", "L0", "NY", "White", "Male", "Hispanic", True, 100.0, 100.0, 0.3, [0.5, 0.2, 0.3, 0.5]))
    rows.append(("Z0002", "L0", "NY", "Black", "Male", "Hispanic", False, 100.0, 100.0, 0.3, [0.5, 0.2, 0.3, 0.5]))
    rows.append(("Z0003", "L0", "NY", "Black", "Female", "Hispanic", False, 90.0, 100.0, 0.3, [0.45, 0.2, 0.3, 0.5]))
    rows.append(("Z0004", "L0", "NY", "White", "Female", "Hispanic", False, 100.0, 100.0, float("inf"), [0.5, 0.2, 1.0, 0.5]))
    return spark.createDataFrame(rows, SCHEMA)


def brute_force(emb, cap=None, top_k=5):
    """The audit's plain formulation: self-join on the block + band predicates."""
    c = F.col
    a = emb.select(*[c(x).alias(f"b_{x}") for x in emb.columns])
    b = emb.select(*[c(x).alias(f"s_{x}") for x in emb.columns])
    j = a.join(b, (c("b_lei") == c("s_lei")) & (c("b_state_code") == c("s_state_code"))
               & (c("b_application_id") < c("s_application_id")))
    j = j.where(
        c("b_income").between(c("s_income") * 0.5, c("s_income") * 2.0)
        & c("b_loan_amount").between(c("s_loan_amount") * 0.5, c("s_loan_amount") * 2.0)
        & (F.abs(c("b_calculated_dti_ratio") - c("s_calculated_dti_ratio")) < 0.2)
    )
    return j.select(c("b_application_id").alias("base_app_id"), c("s_application_id").alias("similar_app_id"))


def test_cell_join_finds_every_band_pair(spark):
    emb = synthetic(spark)
    apps = emb.where(F.abs(F.col("calculated_dti_ratio")) < float("inf"))
    import math
    half = math.log(2.0)
    cand = P.pair_candidates(apps, ["lei", "state_code"], half, half, 0.2).where(P._band(0.5, 2.0, 0.2))
    got = cand.select("base_app_id", "similar_app_id")
    want = brute_force(apps)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_similar_pairs_properties(spark):
    emb = synthetic(spark)
    pairs = P.similar_pairs(emb)
    rows = pairs.collect()
    assert rows, "fixture should produce pairs"
    per_base = {}
    for r in rows:
        assert r.base_app_id < r.similar_app_id
        assert r.financial_similarity_distance < 0.05
        assert r.income_diff_ratio < 0.1 and r.loan_amount_diff_ratio < 0.1 and r.dti_abs_diff < 0.05
        per_base[r.base_app_id] = per_base.get(r.base_app_id, 0) + 1
    assert max(per_base.values()) <= 5
    z = {(r.base_app_id, r.similar_app_id): r for r in rows if r.base_app_id.startswith("Z")}
    assert z[("Z0001", "Z0002")].demographic_difference_type == "RACE_DIFFERENCE"
    assert z[("Z0001", "Z0002")].similarity_strength == "VERY_HIGH_SIMILARITY"
    assert ("Z0001", "Z0003") not in z  # income ratio exactly 0.1 is not < 0.1
    assert not any("Z0004" in k for k in z)  # non-finite DTI never pairs


def test_uncapped_equals_plain_formulation(spark):
    emb = synthetic(spark, n=300, seed=3)
    got = P.similar_pairs(emb, top_k=None).select("base_app_id", "similar_app_id")
    c = F.col
    bf = brute_force(emb.where(F.abs(c("calculated_dti_ratio")) < float("inf")))
    e = emb.select("application_id", "income", "loan_amount", "calculated_dti_ratio", "financial_embedding")
    j = (bf.join(e.toDF("base_app_id", "bi", "bl", "bd", "bv"), "base_app_id")
         .join(e.toDF("similar_app_id", "si", "sl", "sd", "sv"), "similar_app_id"))
    from lendlens.functions.vectors import cosine_distance
    want = j.where(
        (cosine_distance("bv", "sv") < 0.05)
        & (F.abs(c("bi") - c("si")) / F.greatest("bi", "si") < 0.1)
        & (F.abs(c("bl") - c("sl")) / F.greatest("bl", "sl") < 0.1)
        & (F.abs(c("bd") - c("sd")) < 0.05)
    ).select("base_app_id", "similar_app_id")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_plan_has_no_cartesian_product(spark):
    emb = synthetic(spark, n=50)
    plan = P.similar_pairs(emb)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cell_factor_and_salts_do_not_change_results(spark):
    emb = synthetic(spark, n=400, seed=9)
    cols = ["base_app_id", "similar_app_id", "financial_similarity_distance"]
    ref = P.similar_pairs(emb).select(*cols)
    for kwargs in ({"cell_factor": 3.0}, {"cell_factor": 1.0}, {"vector_dim": 4}, {"heavy_cell": 3}):
        got = P.similar_pairs(emb, **kwargs).select(*cols)
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0, kwargs


def test_hot_cell_is_spread_over_tasks(spark):
    """One lender and one cell: its base rows go to many keys, and the result is that of brute force."""
    rows = [(f"H{i:04d}", "LH", "NY", "White", "Male", "Hispanic", i % 2 == 0, 100.0 + i * 1e-4, 200.0, 0.3,
             [0.5, 0.4, 0.3, i / 4000]) for i in range(600)]
    emb = spark.createDataFrame(rows, SCHEMA)
    keys = ["lei", "state_code"]
    cand = P.pair_candidates(emb, keys, 0.1, 0.1, 0.05, vector_col=None, heavy_cell=50)
    per_salt = [r["count"] for r in cand.groupBy("_ci", "_cl", "_cd", "_salt").agg(F.count_distinct("base_app_id").alias("count")).collect()]
    assert len(per_salt) >= 10 and max(per_salt) < 120
    got = P.similar_pairs(emb, heavy_cell=50).select("base_app_id", "similar_app_id")
    want = P.similar_pairs(emb, heavy_cell=10**9).select("base_app_id", "similar_app_id")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert P.similar_pairs(emb, top_k=None, heavy_cell=50).count() == 600 * 599 // 2
