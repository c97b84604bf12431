"""Replaceable tables: a broken write leaves the old table, readers follow the pointer."""

import os

import pytest
from pyspark.sql import functions as F

from lendlens.sources import read_replaced, replace_table


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_replace_and_read(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        read_replaced(spark, path)
    assert ids(replace_table(spark.range(3), path)) == [0, 1, 2]
    begun = read_replaced(spark, path)
    assert ids(replace_table(spark.range(5, 7).withColumn("p", F.col("id") % 2), path, partition_by=["p"])) == [5, 6]
    assert ids(begun) == [0, 1, 2]  # a reader that has begun keeps its version
    assert ids(read_replaced(spark, path)) == [5, 6]
    # the table may be replaced from itself, and only one older version stays
    assert ids(replace_table(read_replaced(spark, path).withColumn("id", F.col("id") + 1), path)) == [6, 7]
    assert len(os.listdir(f"{path}/versions")) == 2
    assert [n for n in os.listdir(path) if n.startswith("_current")] == ["_current"]


def test_broken_write_keeps_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    replace_table(spark.range(4), path)
    # some tasks write their rows, then one fails
    broken = spark.range(0, 4000, 1, 8).withColumn("x", F.when(F.col("id") == 3999, F.raise_error(F.lit("stop here")).cast("int")).otherwise(1))
    with pytest.raises(Exception, match="stop here"):
        replace_table(broken, path)
    assert ids(read_replaced(spark, path)) == [0, 1, 2, 3]
    assert len(os.listdir(f"{path}/versions")) == 1
