"""Staged files, gates, result tables and their round trips."""

import calendar
import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from oriel.sources import results, staged


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("staged")
    for month in (6, 7):
        lines = ["row_no, time ,Raw  ntu,"]
        for k in range(calendar.monthrange(2025, month)[1] * 12):
            slot = staged.SLOTS[k % 12]
            cell = f" {int(slot)}.0" if k % 5 else ("5.87" if k == 10 else slot)
            lines.append(f"{k},{cell},{k / 7:.3f},")
        (path / f"month-2025-{month:02d}.csv").write_text("\n".join([*lines, "9999,,,"]) + "\n")
    return str(path)


def test_scan_clock_and_gates(spark, folder):
    raw = staged.scan_folder(spark, folder, 2)
    assert raw.columns == ["source", "ROW_NO", "TIME", "RAW NTU"]
    with pytest.raises(ValueError, match="2 files"):
        staged.scan_folder(spark, folder, 3)
    assert staged.schema_gate(raw, {"source", "TIME", "ROW_NO"}, {"RAW NTU"}) is raw
    with pytest.raises(ValueError, match=r"missing columns: \['FLOW'\]"):
        staged.schema_gate(raw, {"FLOW"})
    with pytest.raises(ValueError, match="unknown columns"):
        staged.schema_gate(raw, {"TIME"})
    rows = staged.drop_blank(raw)
    assert raw.count() - rows.count() == 2
    month = staged.month_of(F.col("source"))
    expected = F.dayofmonth(F.last_day(month)) * 12
    assert staged.row_count_gate(rows, expected).count() == 61 * 12
    with pytest.raises(Exception, match="361 rows, 360 expected"):
        staged.row_count_gate(raw, expected).collect()
    clocked = staged.with_clock(rows, month, F.col("ROW_NO").cast("int"), F.col("TIME"))
    first = clocked.where("source = 'month-2025-06.csv'").orderBy(F.col("ROW_NO").cast("int")).limit(12).collect()
    assert [r["slot"] for r in first] == list(staged.SLOTS) and str(first[8]["ts"]) == "2025-06-01 23:00:00" and str(first[9]["ts"]) == "2025-06-02 01:00:00" and str(first[9]["op_day"]) == "2025-06-01"
    assert clocked.where("time_repaired").count() == 2
    assert staged.timeline_gate(clocked, 61 * 12) is clocked
    with pytest.raises(ValueError, match="first wrong step at 2025-06-01 11:00:00"):
        staged.timeline_gate(clocked.where("not (ROW_NO = 1 and source like '%06%')"), 61 * 12)
    assert staged.expect(clocked, repaired=(F.col("time_repaired"), 2)) is clocked
    with pytest.raises(ValueError, match=r"'repaired': \(2, 5\)"):
        staged.expect(clocked, repaired=(F.col("time_repaired"), 5))
    with pytest.raises(Exception, match="bad time: noon"):
        staged.checked_time(spark.createDataFrame([("noon",)], "t string"), "t").collect()
    assert staged.checked_time(spark.createDataFrame([(" 700.0",)], "t string"), "t").first()["t"] == "0700"


def test_provenance_and_digest(spark, folder):
    found = {r["path"]: r["sha256"] for r in staged.provenance(spark, folder).collect()}
    for name, digest in found.items():
        assert hashlib.sha256(open(f"{folder}/{name}", "rb").read()).hexdigest() == digest
    rows = staged.drop_blank(staged.scan_folder(spark, folder)).withColumn("ROW_NO", F.col("ROW_NO").cast("int"))
    one = {r["source"]: (r["records"], r["digest"]) for r in staged.semantic_digest(rows, "ROW_NO").collect()}
    assert one == {r["source"]: (r["records"], r["digest"]) for r in staged.semantic_digest(rows.repartition(7), "ROW_NO").collect()} and one["month-2025-06.csv"][0] == 360
    changed = rows.withColumn("RAW NTU", F.when((F.col("ROW_NO") == 3) & F.col("source").contains("06"), "x").otherwise(F.col("RAW NTU")))
    other = {r["source"]: r["digest"] for r in staged.semantic_digest(changed, "ROW_NO").collect()}
    assert other["month-2025-06.csv"] != one["month-2025-06.csv"][1] and other["month-2025-07.csv"] == one["month-2025-07.csv"][1]
    listed = results.manifest(spark, {"input": folder}, {"seed": "42"}).collect()
    assert {r["role"] for r in listed} == {"input", "parameter"} and sum(r["sha256"] is None for r in listed) == 1


NUMBERS = [0.0, 1.0, -2.5, 0.1, 1 / 3, 123456.789012345, 1e10, 12345678901.5, 1e-5, 2.5e-7, 1.23456789e-4, 99999.99999999, None, math.nan, math.inf, -100.0]


def test_ten_digits(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(NUMBERS)], "k int, x double").select("k", results.ten_digits(F.col("x")).alias("t")).collect()
    for k, text in rows:
        x = NUMBERS[k]
        if x is None or not math.isfinite(x):
            assert text is None
        else:
            assert float(text) == float(f"{x:.10g}") and len(text) <= len(f"{x:.10g}") + 1


@pytest.mark.parametrize("mark", [True, False])
def test_text_round_trip(spark, tmp_path, mark):
    table = spark.createDataFrame([("a, \"b\"", 1, 1 / 3), ("é水", 2, None), (None, 3, 2.0)], "name string, n int, x double")
    results.write_text(table, f"{tmp_path}/out", mark, 1)
    file = next(p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbf") == mark
    back = results.read_text(spark, f"{tmp_path}/out", "name string, n int, x double").orderBy("n").collect()
    assert [tuple(r) for r in back] == [("a, \"b\"", 1, 0.3333333333), ("é水", 2, None), (None, 3, 2.0)]
    assert [c.lower() for c in results.read_text(spark, f"{tmp_path}/out").columns] == ["name", "n", "x"]


def test_json_and_paths(spark, tmp_path):
    table = spark.createDataFrame([(1, math.nan, None), (2, 0.5, "x")], "n int, x double, s string")
    assert [json.loads(r["value"]) for r in results.as_json(table.orderBy("n")).collect()] == [{"n": 1, "x": None, "s": None}, {"n": 2, "x": 0.5, "s": "x"}]
    whole = json.loads(results.summary({"b": table, "a": table.limit(0)}).first()["value"])
    assert whole == {"a": [], "b": [{"n": 1, "x": None, "s": None}, {"n": 2, "x": 0.5, "s": "x"}]}
    paths = spark.range(500).selectExpr("id % 50 as path", "id div 50 as t_idx", "rand(1) as y")
    results.write_paths(paths, f"{tmp_path}/paths", 4)
    back = spark.read.parquet(f"{tmp_path}/paths").select("path", "t_idx", "y")
    assert sorted(map(str, back.collect())) == sorted(map(str, paths.collect()))


def test_validation(spark):
    good, bad, none = (spark.createDataFrame(rows, "a string, b int") for rows in ([("x", 1), ("=A1", 2)], [("#REF!", 1)], []))
    assert [(r["table"], r["rows"], r["formulas"]) for r in results.validate({"t": good}, {"t"}).collect()] == [("t", 2, 1)]
    for tables, required in (({"t": bad}, {"t"}), ({"t": none}, {"t"}), ({"t": good}, {"u"})):
        with pytest.raises(ValueError):
            results.validate(tables, required)
