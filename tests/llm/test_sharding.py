"""Feistel sharding against a permutation that is written out."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlens.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1000, 4097])
def test_permutation_and_inverse(n):
    p = sharding.Feistel(n, 7)
    placed = p.place(np.arange(n))
    assert sorted(placed) == list(range(n))
    assert (p.row(placed) == np.arange(n)).all()
    assert p.a * p.b >= n and p.a * p.b - n < max(p.a, p.b)
    one = [sharding.Feistel(n, 7).place(np.array([k]))[0] for k in range(min(n, 50))]
    assert one == list(placed[:50])  # a place depends on the number alone, not on its neighbours


def test_cycle_walk_leaves_no_gap():
    """13 numbers in a 4 x 4 square: some must walk on."""
    p = sharding.Feistel(13, 3)
    first = p._round_trip(np.arange(13), False)
    assert p.a * p.b > 13 and (first >= 13).any() and sorted(p.place(np.arange(13))) == list(range(13))


def test_bad_numbers():
    with pytest.raises(ValueError):
        sharding.Feistel(5).place(np.array([5]))
    with pytest.raises(ValueError):
        sharding.Feistel(-1)


def test_shuffle_looks_random():
    """Neighbours in the input are spread: shard counts of a run of 2,400 rows of 100,000 stay near
    100 each, and the places of a run have no trend."""
    p = sharding.Feistel(100_000)
    run = p.place(np.arange(50_000, 52_400))
    counts = np.bincount(run % 24, minlength=24)
    assert ((counts - 100.0) ** 2 / 100).sum() < 60
    assert abs(np.corrcoef(run, np.arange(len(run)))[0, 1]) < 0.1
    assert not (sharding.Feistel(100_000, 1).place(np.arange(100)) == sharding.Feistel(100_000, 2).place(np.arange(100))).all()


def brute(rows, shards):
    """Rows in their defined order, numbered, permuted one by one."""
    def key(r):
        b = (r[1] or "").encode()
        return (r[0] is not None, r[0] or 0, zlib.crc32(b), len(b) + 8)
    rows = sorted(rows, key=key)
    out = []
    for i, r in enumerate(rows):
        shard, slot = sharding.locate(i, len(rows), shards)
        b = (r[1] or "").encode()
        out.append((r[0], len(b) + 8, zlib.crc32(b), shard, slot, i))
    return sorted(out, key=str)


def test_assign_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    cols = ["doc_id", "size", "text_crc32", "shard", "slot", "row_number"]
    for shards in (24, 5, 1000):
        got = sharding.assign(docs.repartition(3), shards).select(*cols).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows, shards)


def test_laws(spark, docs):
    many = docs.crossJoin(spark.range(30).select(F.col("id").alias("k"))).withColumn(
        "doc_id", F.when(F.col("k") < 10, F.lit(None)).otherwise(F.col("doc_id") * 100 + F.col("k"))
    )
    got = sharding.assign(many).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == many.count() and len(slots) == 24
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in got[::37]:
        assert sharding.row_at(r["shard"], r["slot"], len(got)) == r["row_number"]


def test_partitioning_does_not_matter(spark, docs):
    one = sharding.assign(docs.coalesce(1)).collect()
    assert sorted(map(str, sharding.assign(docs.repartition(7)).collect())) == sorted(map(str, one))


def test_repeated_rows_and_empty(spark, empty):
    same = spark.range(25_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("shard"))
    got = sharding.assign(same)
    assert got.count() == 25_000 and got.select("row_number").distinct().count() == 25_000
    assert got.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert sharding.assign(empty).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(empty, 0)


def test_written_shards(spark, docs, tmp_path):
    back = sharding.write_shards(docs, f"{tmp_path}/out", shards=4, pieces=2).collect()
    want = sorted((str(r["doc_id"]), str(r["text"])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in back) == want
    assert sorted((r["shard"], r["slot"]) for r in back) == sorted((k % 4, k // 4) for k in range(len(want)))


def test_query_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sharding.op11_sharding(spark, d).collect()
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"], r["row_number"]) for r in got), key=str) == brute(rows, 24)
