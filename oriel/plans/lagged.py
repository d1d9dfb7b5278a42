"""Queries that compare a series with itself or another some steps before: one window and one aggregation for all steps, by series.

Their SQL for DuckDB joins slots with earlier slots instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from oriel.operators.calendar import ONE, regular_slots
from oriel.sources import read_table

ACF_LAGS, CROSS_LAGS, HORIZONS = range(1, 13), range(7), range(1, 7)


def _order() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("t_idx")


def _slots(spark: SparkSession, sf_dir: str, series: str) -> DataFrame:
    return regular_slots(read_table(spark, sf_dir, "events"), series)


def _table(grouped, values: dict[int, Column], step: str, value: str) -> DataFrame:
    """One row a step from one aggregation of all of them."""
    parts = F.array(*[F.struct(F.lit(k).alias(step), v.alias(value)) for k, v in values.items()])
    return grouped.agg(parts.alias("all")).select("series_id", F.inline("all"))


def residual_acf(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Autocorrelation of the persistence's errors, 1 to 12 known errors apart."""
    errors = _slots(spark, sf_dir, series).select("series_id", "t_idx", (F.col("ntu") - F.lag("ntu", 1).over(_order())).alias("e")).where("e is not null")
    centred = errors.withColumn("c", F.col("e") - F.avg("e").over(Window.partitionBy("series_id")))
    rows = centred.select("series_id", "c", *[F.lag("c", k).over(_order()).alias(f"c{k}") for k in ACF_LAGS])
    values = {k: F.round(F.sum(F.col("c") * F.col(f"c{k}")) / F.sum(F.col("c") * F.col("c")), 6) for k in ACF_LAGS}
    return _table(rows.groupBy("series_id"), values, "lag_steps", "acf")


def crosscorr_peak(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Correlation of the steps of two series, 0 to 6 slots apart, and where it is largest; of equal ones the least lag, and none where no lag has a correlation."""
    moved = _slots(spark, sf_dir, series).select("series_id", "t_idx", *[(F.col(c) - F.lag(c, 1).over(_order())).alias(n) for c, n in (("rw", "x"), ("filt", "y"))])
    rows = moved.select("series_id", "y", *[F.lag("x", k).over(_order()).alias(f"x{k}") for k in CROSS_LAGS])
    found = _table(rows.groupBy("series_id"), {k: F.nullif(F.corr(f"x{k}", "y"), F.lit(float("nan"))) for k in CROSS_LAGS}, "steps", "r")
    largest = Window.partitionBy("series_id").orderBy(F.desc(F.round(F.abs("r"), 9)), "steps")  # seven rows a series
    return found.select("series_id", "steps", F.round("r", 6).alias("r"), ((F.row_number().over(largest) == 1) & F.col("r").isNotNull()).alias("peak"))


def persistence_by_horizon(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Errors of the last value as a forecast, 2 to 12 hours ahead."""
    ahead = F.array(*[F.struct(F.lit(2 * h).alias("horizon_hours"), F.lead("ntu", h).over(_order()).alias("y")) for h in HORIZONS])
    rows = _slots(spark, sf_dir, series).select("series_id", F.col("ntu").alias("p"), ahead.alias("ahead")).select("series_id", "p", F.inline("ahead")).where("p is not null and y is not null")
    off = F.col("p") - F.col("y")
    r2 = F.when(F.max("y") > F.min("y"), F.round(1 - F.sum(off * off) / (F.var_pop("y") * F.count("*")), 6))
    return rows.groupBy("series_id", "horizon_hours").agg(F.round(F.sqrt(F.avg(off * off)), 6).alias("rmse"), F.round(F.avg(F.abs(off)), 6).alias("mae"), r2.alias("r2"), F.count("*").alias("n"))


QUERIES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (residual_acf, crosscorr_peak, persistence_by_horizon)}

SQL = {
    "residual_acf": """WITH e AS (SELECT a.series_id, a.t_idx, a.ntu - b.ntu AS e FROM slots a JOIN slots b ON b.series_id = a.series_id AND b.t_idx = a.t_idx - 1 WHERE a.ntu IS NOT NULL AND b.ntu IS NOT NULL),
n AS (SELECT e.series_id, e - mean AS c, row_number() OVER (PARTITION BY e.series_id ORDER BY t_idx) AS i FROM e JOIN (SELECT series_id, avg(e) AS mean FROM e GROUP BY series_id) m ON m.series_id = e.series_id),
whole AS (SELECT series_id, sum(c * c) AS total FROM n GROUP BY series_id)
SELECT a.series_id, k AS lag_steps, round(sum(a.c * b.c) / max(total), 6) AS acf FROM range(1, 13) AS t(k) CROSS JOIN n a JOIN n b ON b.series_id = a.series_id AND b.i = a.i - k JOIN whole w ON w.series_id = a.series_id GROUP BY a.series_id, k""",
    "crosscorr_peak": """WITH d AS (SELECT a.series_id, a.t_idx, a.rw - b.rw AS x, a.filt - b.filt AS y FROM slots a JOIN slots b ON b.series_id = a.series_id AND b.t_idx = a.t_idx - 1),
c AS (SELECT a.series_id, k AS steps, nullif(corr(b.x, a.y), 'NaN'::DOUBLE) AS r FROM range(0, 7) AS t(k) CROSS JOIN d a JOIN d b ON b.series_id = a.series_id AND b.t_idx = a.t_idx - k GROUP BY a.series_id, k),
best AS (SELECT series_id, max(round(abs(r), 9)) AS most FROM c GROUP BY series_id)
SELECT c.series_id, c.steps, round(r, 6) AS r, coalesce(c.steps = (SELECT min(o.steps) FROM c o WHERE o.series_id = c.series_id AND round(abs(o.r), 9) = most), false) AS peak FROM c JOIN best ON best.series_id = c.series_id""",
    "persistence_by_horizon": """WITH p AS (SELECT a.series_id, 2 * h AS horizon_hours, b.ntu AS y, a.ntu AS p FROM range(1, 7) AS t(h) CROSS JOIN slots a JOIN slots b ON b.series_id = a.series_id AND b.t_idx = a.t_idx + h WHERE a.ntu IS NOT NULL AND b.ntu IS NOT NULL)
SELECT series_id, horizon_hours, round(sqrt(avg(pow(p - y, 2))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, CASE WHEN max(y) > min(y) THEN round(1 - sum(pow(p - y, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) END AS r2, count(*) AS n FROM p GROUP BY series_id, horizon_hours""",
}
