import math

from pyspark.sql import functions as F

from lendlens.functions import exprs as X
from lendlens.functions import vectors as V


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_ieee_divide(spark):
    r = one(
        spark,
        X.ieee_divide(F.lit(1.0), F.lit(0.0)).alias("pinf"),
        X.ieee_divide(F.lit(-1.0), F.lit(0.0)).alias("ninf"),
        X.ieee_divide(F.lit(0.0), F.lit(0.0)).alias("nan"),
        X.ieee_divide(F.lit(6.0), F.lit(3.0)).alias("two"),
        X.ieee_divide(F.lit(None).cast("double"), F.lit(0.0)).alias("null"),
    )
    assert r.pinf == math.inf and r.ninf == -math.inf and math.isnan(r.nan) and r.two == 2.0 and r.null is None


def test_safe_divide_and_guarded_least(spark):
    r = one(
        spark,
        X.safe_divide(F.lit(1.0), F.lit(0.0)).alias("sd"),
        X.guarded_least(100, F.lit(None).cast("double")).alias("gl_null"),
        X.guarded_least(100, F.lit(250.0)).alias("gl_cap"),
        X.guarded_least(100, F.lit(12.5)).alias("gl_val"),
    )
    assert r.sd is None and r.gl_null is None and r.gl_cap == 100.0 and r.gl_val == 12.5


def test_exceeds_treats_nan_as_default(spark):
    r = one(
        spark,
        X.exceeds(F.lit(float("nan")), 1.96, 0.0).alias("nan"),
        X.exceeds(F.lit(None).cast("double"), 1.96, 0.0).alias("null"),
        X.exceeds(F.lit(float("inf")), 1.96, 0.0).alias("inf"),
        X.exceeds(F.lit(1.96), 1.96, 0.0).alias("eq"),
        X.below(F.lit(None).cast("double"), 0.8, 1.0).alias("below_null"),
        X.below(F.lit(0.8), 0.8, 1.0).alias("below_eq"),
    )
    assert (r.nan, r.null, r.inf, r.eq, r.below_null, r.below_eq) == (False, False, True, False, False, False)


def test_band_edges(spark):
    bands = [(150, "H"), (80, "M"), (50, "LM")]
    rows = spark.createDataFrame([(150.0,), (149.9,), (80.0,), (50.0,), (49.99,), (None,)], "x double")
    got = [r.b for r in rows.select(X.band(F.col("x"), bands, "L").alias("b")).collect()]
    assert got == ["H", "M", "M", "LM", "L", "L"]


def test_num_text_matches_warehouse_casts(spark):
    r = one(
        spark,
        X.num_text(F.lit(150.4), 0).alias("r0"),
        X.num_text(F.lit(2.5), 0).alias("half"),
        X.num_text(F.lit(0.12345), 3).alias("r3"),
        X.num_text(F.lit(1.0), 3).alias("one"),
        X.num_text(F.lit(-0.59)).alias("plain"),
        X.num_text(F.lit(2.0)).alias("int_like"),
    )
    assert (r.r0, r.half, r.r3, r.one, r.plain, r.int_like) == ("150", "3", "0.123", "1", "-0.59", "2")


def test_md5_unit_and_stable_hash(spark):
    import hashlib

    r = one(spark, X.md5_unit(F.lit(7), "race").alias("u"), X.stable_hash64(F.lit("k")).alias("h"))
    assert r.u == int(hashlib.md5(b"7race").hexdigest()[:7], 16) % 1000
    assert r.h == int(hashlib.md5(b"k").hexdigest()[:15], 16)


def test_cosine_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])],
                               "a array<double>, b array<double>")
    got = [r.d for r in df.select(V.cosine_distance("a", "b").alias("d")).collect()]
    assert got[0] == 1.0 and abs(got[1]) < 1e-12 and got[2] is None


def test_element_out_of_range_is_null(spark):
    r = one(spark, V.element(F.array(F.lit(1.0), F.lit(2.0)), 5).alias("e"))
    assert r.e is None
