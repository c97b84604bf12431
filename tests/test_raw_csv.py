"""The accounting CSV scan: accepted, rejected by reason, fail mode."""

import pytest

from lendlens.sources import reject_counts, scan_raw_csv
from lendlens.sources.raw import RAW_COLUMNS

GOOD = "L1,2024,CA,6,100,2,5,1,25-34,80,200.0,0.5,36%,1,1,1,House,Conv,1,5000,30.5,90000.0,110.0,1,,,"


def scan(spark, tmp_path, lines, **more):
    (tmp_path / "a.csv").write_text("\n".join([",".join(RAW_COLUMNS), *lines]) + "\n")
    return scan_raw_csv(spark, str(tmp_path / "a.csv"), **more)


def test_reasons(spark, tmp_path):
    short, long, value = GOOD.rsplit(",", 5)[0], GOOD + ",9", GOOD.replace("200.0", "lots")
    quoted = GOOD.replace("House", '"a, b"')
    accepted, rejected = scan(spark, tmp_path, [GOOD, short, long, value, quoted, GOOD.replace(",2024,", ",20x4,")])
    assert [r["derived_dwelling_category"] for r in accepted.collect()] == ["House", "a, b"]
    assert {r["reason"]: r["n_rows"] for r in reject_counts(accepted, rejected).collect()} == {"accepted": 2, "columns": 2, "value": 2}
    assert {(r["reason"], r["record"]) for r in rejected.collect()} >= {("columns", short), ("columns", long), ("value", value)}
    assert rejected.count() == 4 and accepted.count() == 2
    per_file = reject_counts(accepted, rejected, per_file=True).collect()
    assert all(r["file"].endswith("a.csv") for r in per_file) and len(per_file) == 2


def test_fail_mode_and_empty(spark, tmp_path):
    accepted, _ = scan(spark, tmp_path, [GOOD, GOOD + ",9"], mode="fail")
    with pytest.raises(Exception, match="bad record in"):
        accepted.collect()
    assert scan(spark, tmp_path, [GOOD], mode="fail")[0].count() == 1
    accepted, rejected = scan(spark, tmp_path, [])
    assert accepted.collect() == [] and rejected.collect() == []
    with pytest.raises(ValueError):
        scan(spark, tmp_path, [], mode="ignore")
