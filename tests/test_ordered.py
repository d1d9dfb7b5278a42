"""Global order against a sort in one place, digests whatever the partitions."""

import random

import pytest
from pyspark.sql import functions as F

from oriel.operators.ordered import in_order
from oriel.session import release
from oriel.sources import staged


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_order_over_ranges(spark, partitions):
    rng = random.Random(partitions)
    # One time that a third of the rows share, nulls, and fewer different times than ranges.
    rows = [(k, rng.choice([None, 5, 5, 5, *range(8)]), rng.choice([None, "x", "y"])) for k in range(300)]
    found = in_order(spark.createDataFrame(rows, "k int, t int, s string").repartition(7), "t", "k", previous=("k", "s"), partitions=partitions)
    plain = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    expected = [(*r, i, *((plain[i - 1][0], plain[i - 1][2]) if i else (None, None))) for i, r in enumerate(plain)]
    assert [tuple(r) for r in found.orderBy("row_no").collect()] == expected
    release(found)


def test_order_of_nothing(spark):
    found = in_order(spark.createDataFrame([], "t int"), "t", previous=("t",))
    assert found.count() == 0 and found.columns == ["t", "row_no", "previous_t"]


def test_plan_has_no_window_over_all_rows(spark):
    plan = in_order(spark.range(1000), "id", previous=("id",))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_range" in plan and plan.count("SinglePartition") == 1  # the borders, one row a range


def test_timeline_gate_finds_repeats(spark):
    rows = spark.range(48).select(F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(2 * id as int))").alias("ts"))
    assert staged.timeline_gate(rows, 48) is rows
    with pytest.raises(ValueError, match="49 rows, 48 times"):
        staged.timeline_gate(rows.union(rows.limit(1)), 48)
    with pytest.raises(ValueError, match="49 rows, 48 times"):
        staged.timeline_gate(rows.union(spark.sql("select cast(null as timestamp)")), 48)


@pytest.mark.parametrize("bits", [2, 16])
def test_tree_digest(spark, bits):
    rows = spark.range(200).selectExpr("concat('f', id % 3) as source", "id div 3 as row_no", "concat(' ', id, ' ') as cell", "if(id % 7 = 0, null, id) as n")
    own = {r["source"]: tuple(r) for r in staged.semantic_digest(rows.repartition(11), "row_no", bits=bits).collect()}
    assert own == {r["source"]: tuple(r) for r in staged.semantic_digest(rows.coalesce(1), "row_no", bits=bits).collect()}
    assert [own[f"f{k}"][1] for k in range(3)] == [67, 67, 66]
    # Two rows that trade places change their file's digest alone; spaces don't.
    traded = rows.withColumn("row_no", F.expr("if(source = 'f1', case row_no when 3 then 60 when 60 then 3 else row_no end, row_no)")).withColumn("cell", F.trim("cell"))
    other = {r["source"]: tuple(r) for r in staged.semantic_digest(traded, "row_no", bits=bits).collect()}
    assert other["f0"] == own["f0"] and other["f2"] == own["f2"] and other["f1"] != own["f1"]
