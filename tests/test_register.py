"""Ids that stay when files are added: the register against a plain-Python version."""

from collections import Counter

import pytest
from lendlens.operators.register import content_key, load_applications
from lendlens.sources import read_replaced

SCHEMA = "lei string, activity_year int, loan_amount double, note string"
HOT = ("A", 2024, 1.0, "hot")
FIRST = [HOT] * 40 + [("A", 2024, float(i), None) for i in range(30)] + [("B", 2024, 1.0, ""), ("B", 2024, 1.0, None)]
ADDED = [HOT] * 25 + [("A", 2024, float(i), None) for i in range(25, 45)] + [("C", 2023, 2.0, "x"), (None, 2024, 3.0, "n")] * 2


def plain(loads, spark):
    """Numbers of every copy of every content after ``loads``, each holding all rows so far."""
    given, marks = {}, Counter()
    for rows in loads:
        counts = Counter(r for r in rows if r[0] is not None)
        frame = spark.createDataFrame(list(counts) or [("", 0, 0.0, "")], SCHEMA)
        keys = {tuple(r)[:4]: r["k"] for r in frame.withColumn("k", content_key(frame.columns)).collect()}
        for row in sorted(counts, key=lambda r: (r[0], keys[r])):
            have = given.setdefault(row, [])
            while len(have) < counts[row]:
                marks[row[0]] += 1
                have.append(marks[row[0]])
    return given


def numbers(df):
    out = {}
    for r in df.collect():
        row = (r["lei"], r["activity_year"], r["loan_amount"], r["note"])
        if row[0] is None:
            assert r["application_id"] is None and r["first_load"] is None
            continue
        lei, year, n = r["application_id"].split("_")
        assert (lei, int(year)) == row[:2]
        out.setdefault(row, []).append(int(n))
    return {k: sorted(v) for k, v in out.items()}


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("piece", [7, 65_536])  # 7: the hot content's runs are given out in pieces
def test_two_loads(spark, tmp_path, piece):
    path = str(tmp_path / "register")
    first = numbers(load_applications(rows(spark, FIRST), path, piece=piece))
    assert first == plain([FIRST], spark)
    both = load_applications(rows(spark, FIRST + ADDED), path, piece=piece)
    assert both.count() == len(FIRST) + len(ADDED)
    second = numbers(both)
    assert second == plain([FIRST, FIRST + ADDED], spark)
    assert all(set(first[k]) <= set(second[k]) for k in first)  # the first load's ids stay
    lei_a = sorted(n for k, v in second.items() if k[0] == "A" for n in v)
    assert lei_a == list(range(1, len(lei_a) + 1))  # gapless
    assert {r["first_load"] for r in both.where("loan_amount = 44").collect()} == {2}


def test_again_fewer_and_back(spark, tmp_path):
    path = str(tmp_path / "register")
    first = numbers(load_applications(rows(spark, FIRST), path))
    held = read_replaced(spark, path).count()
    assert numbers(load_applications(rows(spark, FIRST), path)) == first  # the same load again
    fewer = numbers(load_applications(rows(spark, FIRST[30:]), path))
    assert len(fewer[HOT]) == 10 and set(fewer[HOT]) <= set(first[HOT])
    assert load_applications(rows(spark, []), path).collect() == []
    assert numbers(load_applications(rows(spark, FIRST), path)) == first  # rows that left come back
    assert read_replaced(spark, path).count() == held


def test_added_files_alone(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    first = numbers(load_applications(rows(spark, FIRST), one))
    added = numbers(load_applications(rows(spark, ADDED), one, whole=False))
    assert not {(k[0], n) for k, v in first.items() for n in v} & {(k[0], n) for k, v in added.items() for n in v}
    load_applications(rows(spark, FIRST), two)
    whole = numbers(load_applications(rows(spark, FIRST + ADDED), two))
    assert {k: sorted(first.get(k, []) + added.get(k, [])) for k in whole} == whole


def test_null_is_not_empty(spark, tmp_path):
    df = rows(spark, [("B", 2024, 1.0, ""), ("B", 2024, 1.0, None), ("B", 2024, None, "1"), (None, None, None, None)])
    assert len({r["k"] for r in df.select(content_key(df.columns).alias("k")).collect()}) == 4
    assert load_applications(df, str(tmp_path / "r")).count() == 4
