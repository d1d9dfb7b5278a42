"""Queries of daily risk and of filled gaps, by series; their SQL for DuckDB finds runs as islands of row numbers and joins gaps with their ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.operators import risk
from oriel.operators.calendar import ONE, regular_slots
from oriel.sources import read_table

LIMIT = risk.LIMIT


def _slots(spark: SparkSession, sf_dir: str, series: str) -> DataFrame:
    return regular_slots(read_table(spark, sf_dir, "events"), series)


def impute_fill(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Gaps of filt on straight lines, held after three slots."""
    return risk.interpolated(_slots(spark, sf_dir, series), "filt").withColumn("filled", F.round("filled", 6))


def daily_risk(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Valid slots, maximum, amplitude, longest run and load of each day."""
    days = risk.daily_risk(_slots(spark, sf_dir, series))
    return days.withColumns({c: F.round(c, 6) for c in ("max_value", "amplitude", "exceedance_load")}).withColumnRenamed("max_value", "max_ntu")


def risk_grades(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """The grade of each day, and what it rests on."""
    return risk.daily_risk(_slots(spark, sf_dir, series)).select("series_id", "op_day", risk.grade().alias("grade"), F.round("amplitude", 6).alias("amplitude"), "longest_hours")


def grade_summary(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """How many days have each grade, and their share."""
    days = risk.daily_risk(_slots(spark, sf_dir, series)).withColumn("grade", risk.grade())
    one = lambda g: F.struct(F.lit(g).alias("grade"), F.count_if(F.col("grade") == g).alias("days"), F.round(F.count_if(F.col("grade") == g) / F.count("*"), 6).alias("proportion"))
    return days.groupBy("series_id").agg(F.array(*[one(g) for g in (*risk.GRADES, risk.NO_GRADE)]).alias("all")).select("series_id", F.inline("all"))


def risk_robustness_81(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Share of days that keep their grade under each of 81 sets of bounds."""
    found = risk.unchanged_share(risk.daily_risk(_slots(spark, sf_dir, series)), (8.0, 10.0, 12.0), (18.0, 20.0, 22.0), (2, 4, 6), (6, 8, 10))
    return found.withColumn("unchanged", F.round("unchanged", 6))


QUERIES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (impute_fill, daily_risk, risk_grades, grade_summary, risk_robustness_81)}

#: A day's amplitude, longest run over the limit in slots (nulls removed first), load and valid values.
DAYS = f"""
valid AS (SELECT series_id, op_day, t_idx, ntu, row_number() OVER (PARTITION BY series_id, op_day ORDER BY t_idx) AS i FROM slots WHERE ntu IS NOT NULL),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY series_id, op_day, ntu > {LIMIT} ORDER BY t_idx) AS island, ntu > {LIMIT} AS above FROM valid),
lengths AS (SELECT series_id, op_day, count(*) AS slots FROM runs WHERE above GROUP BY series_id, op_day, island),
longest AS (SELECT series_id, op_day, max(slots) AS slots FROM lengths GROUP BY series_id, op_day),
sums AS (SELECT series_id, op_day, count(*) AS valid_points, max(ntu) AS max_ntu, max(greatest(ntu - {LIMIT}, 0.0)) AS amplitude, sum(greatest(ntu - {LIMIT}, 0.0)) * 2 AS exceedance FROM valid GROUP BY series_id, op_day),
days AS (SELECT sums.*, coalesce(slots, 0) * 2 AS hours FROM sums LEFT JOIN longest ON longest.series_id = sums.series_id AND longest.op_day = sums.op_day)
"""


def _grade(low: str = "10.0", medium: str = "20.0", short: str = "4", long: str = "8") -> str:
    return f"CASE WHEN valid_points < 9 THEN 'INSUFFICIENT' WHEN amplitude <= 0 THEN 'SAFE' WHEN amplitude <= {low} AND hours <= {short} THEN 'LOW' WHEN amplitude <= {medium} AND hours <= {long} THEN 'MEDIUM' ELSE 'HIGH' END"


SQL: dict[str, str] = {
    "impute_fill": """WITH a AS (SELECT series_id, t_idx, filt,
            max(CASE WHEN filt IS NOT NULL THEN t_idx END) OVER (PARTITION BY series_id ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
            min(CASE WHEN filt IS NOT NULL THEN t_idx END) OVER (PARTITION BY series_id ORDER BY t_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM slots),
        b AS (SELECT a.series_id, a.t_idx, a.p, a.q, x.filt AS before, y.filt AS after FROM a LEFT JOIN slots x ON x.series_id = a.series_id AND x.t_idx = a.p LEFT JOIN slots y ON y.series_id = a.series_id AND y.t_idx = a.q)
        SELECT series_id, t_idx, round(CASE WHEN before IS NULL THEN after WHEN after IS NULL OR p = q THEN before WHEN t_idx - p <= 3 THEN before + (after - before) * (t_idx - p) / (q - p) ELSE before + (after - before) * 3 / (q - p) END, 6) AS filled FROM b""",
    "daily_risk": f"WITH {DAYS} SELECT series_id, op_day, CAST(valid_points AS BIGINT) AS valid_points, round(max_ntu, 6) AS max_ntu, round(amplitude, 6) AS amplitude, CAST(hours AS BIGINT) AS longest_hours, round(exceedance, 6) AS exceedance_load FROM days",
    "risk_grades": f"WITH {DAYS} SELECT series_id, op_day, {_grade()} AS grade, round(amplitude, 6) AS amplitude, CAST(hours AS BIGINT) AS longest_hours FROM days",
    "grade_summary": f"WITH {DAYS}, g AS (SELECT series_id, {_grade()} AS grade FROM days), d AS (SELECT * FROM (SELECT DISTINCT series_id FROM days) a CROSS JOIN (VALUES ('SAFE'), ('LOW'), ('MEDIUM'), ('HIGH'), ('INSUFFICIENT')) AS d(grade)) SELECT d.series_id, d.grade, CAST(count(g.grade) AS BIGINT) AS days, round(count(g.grade) / CAST(sum(count(g.grade)) OVER (PARTITION BY d.series_id) AS DOUBLE), 6) AS proportion FROM d LEFT JOIN g ON g.grade = d.grade AND g.series_id = d.series_id GROUP BY d.series_id, d.grade",
    "risk_robustness_81": f"WITH {DAYS}, a AS (SELECT * FROM (VALUES (8.0), (10.0), (12.0)) AS a(low)), b AS (SELECT * FROM (VALUES (18.0), (20.0), (22.0)) AS b(medium)), c AS (SELECT * FROM (VALUES (2), (4), (6)) AS c(brief)), d AS (SELECT * FROM (VALUES (6), (8), (10)) AS d(lasting)) SELECT series_id, CAST(low AS DOUBLE) AS low, CAST(medium AS DOUBLE) AS medium, brief, lasting, round(avg(CASE WHEN {_grade()} = {_grade('low', 'medium', 'brief', 'lasting')} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS unchanged FROM days CROSS JOIN a CROSS JOIN b CROSS JOIN c CROSS JOIN d GROUP BY series_id, low, medium, brief, lasting",
}
