"""Cells, profiles and counted p-values on small tables."""

from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.operators.two_samples import counted_p, two_sample_distance
from oriel.plans import queries as series
from oriel.sources.records import record_profile, spread, with_record
from oriel.sources.stored import in_month, read_days, store_by_day


def test_cells(spark):
    texts = [("", None, False), (" - ", None, False), (None, None, False), ("48..9", None, True), (" 7.3 ", 7.3, False), ("NaN", None, True), ("-1e2", -100.0, False), ("x", None, True)]
    rows = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(texts)], "id long, a string")
    made = with_record(rows, {"a": F.col("a"), "b": F.lit(None).cast("string")})
    found = spread(made, ["a", "b"], "id").orderBy("id").collect()
    assert [(r["a_raw"], r["a"], r["a_invalid"]) for r in found] == texts and all(r["b"] is None and r["b_invalid"] is False for r in found)
    profile = {r["field"]: r for r in record_profile(made, ["a", "b"]).collect()}
    assert (profile["a"]["total"], profile["a"]["missing"], profile["a"]["invalid"], profile["a"]["minimum"]) == (8, 6, 3, -100.0)
    assert profile["b"]["median_value"] is None and profile["b"]["missing_rate"] == 1.0
    assert record_profile(made.where("false"), ["a", "b"]).count() == 0


@pytest.mark.parametrize("m, n", [(3, 4), (5, 5), (4, 7), (6, 3), (1, 9)])
def test_counted_p_is_the_share_of_orders(m, n):
    found = []
    for first in combinations(range(m + n), m):
        i = j = most = 0
        for k in range(m + n):
            i, j = (i + 1, j) if k in first else (i, j + 1)
            most = max(most, abs(i * n - j * m))
        found.append(most)
    for apart in sorted({*found, 0, m * n}):
        assert np.isclose(counted_p(apart, m, n), sum(f >= apart for f in found) / comb(m + n, m))


def test_distance_by_series(spark):
    rng = np.random.default_rng(2)
    data = [("a", float(x), True) for x in rng.normal(0, 1, 30)] + [("a", float(x), False) for x in rng.normal(1, 1, 20)] + [("b", 1.0, True), ("b", None, False)]
    found = {r["s"]: r for r in two_sample_distance(spark.createDataFrame(data, "s string, x double, early boolean"), ["s"], "x", "early").collect()}
    one, two = (np.array([x for s, x, e in data if s == "a" and e is early]) for early in (True, False))
    d = max(abs((one <= x).mean() - (two <= x).mean()) for x in np.r_[one, two])
    assert np.isclose(found["a"]["d_statistic"], d) and np.isclose(found["a"]["p"], counted_p(round(d * 600), 30, 20)) and found["a"]["counted"]
    assert found["b"]["p"] is None and found["b"]["n_second"] == 0


def test_query_agrees_with_the_asymptotic_one(spark):
    a, b = (series.QUERIES[q](spark, "/root/testdata/sf0.001").first() for q in ("ks_counted", "ks_two_sample"))
    assert np.isclose(a["d_statistic"], b["d_statistic"], atol=1e-6) and abs(a["p"] - b["p_asymptotic"]) < 0.05


def test_days_outside_the_range_are_not_read(spark, tmp_path):
    slots = spark.createDataFrame([("s", k, f"2024-01-{k:02d}", float(k)) for k in range(1, 29)], "series_id string, t_idx long, op_day string, ntu double").withColumn("op_day", F.col("op_day").cast("date"))
    path = store_by_day(slots, str(tmp_path / "days"))
    read = read_days(spark, path, "2024-01-05", "2024-01-07")
    assert [r["t_idx"] for r in read.orderBy("t_idx").collect()] == [5, 6, 7] and len(read.inputFiles()) >= 3
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(op_day" in plan and "PushedFilters: []" in plan
    assert spark.read.parquet(path).where(in_month(F.col("op_day"), "2024-02")).count() == 0


@pytest.mark.parametrize("most", [16, 4096])
def test_medians_of_many_distinct_cells(spark, most):
    """More distinct values than a round tells apart, an even count, a field without numbers."""
    rows = spark.range(3000).selectExpr("cast((id * 7919) % 3001 / 7 as string) as a", "'-' as b", "if(id % 2 = 0, 'x', cast(id as string)) as c").repartition(5)
    made = with_record(rows, {c: F.col(c) for c in "abc"})
    found = {r["field"]: r for r in record_profile(made, list("abc"), most).collect()}
    values = sorted((k * 7919) % 3001 / 7 for k in range(3000))
    assert found["a"]["median_value"] == pytest.approx((values[1499] + values[1500]) / 2, abs=1e-6)
    assert found["b"]["median_value"] is None and found["b"]["missing"] == 3000 and found["b"]["invalid"] == 0
    assert found["c"]["median_value"] == 1500.0 and found["c"]["invalid"] == 1500
