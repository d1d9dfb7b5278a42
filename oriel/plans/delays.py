"""Fits of two delayed factors over a grid, and rank correlations over drawn blocks, by series.

Their SQL for DuckDB solves the fits from raw sums, and copies the rows of drawn blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.calendar import ONE, regular_slots
from oriel.operators.factors import block_intervals
from oriel.plans.series_sql import FOLD_DAYS, FOLDS, W
from oriel.sources import read_table

MOST_DELAY, RIDGES = 3, (0.01, 0.1, 1.0, 10.0, 100.0)
DRAWN, REPEATS, BLOCK = ("rw", "alum", "ph"), 200, 12


def _slots(spark: SparkSession, sf_dir: str, series: str) -> DataFrame:
    return regular_slots(read_table(spark, sf_dir, "events"), series)


def _two_factor_fit(t: Callable[[str], Column], ridge: Column) -> tuple[Column, Column, Column]:
    """Intercept and weights of a ridge on two standardised factors, from the training rows' means, variances and covariances."""
    n = t("n").cast("double")
    s1, s2 = (F.sqrt(F.greatest(t(v), F.lit(1e-20))) for v in ("v1", "v2"))
    q12, q1, q2 = n * t("c12") / s1 / s2, n * t("c1y") / s1, n * t("c2y") / s2
    own, det = n + ridge, (n + ridge) * (n + ridge) - q12 * q12
    g1, g2 = (own * q1 - q12 * q2) / det / s1, (own * q2 - q12 * q1) / det / s2
    return t("my") - g1 * t("m1") - g2 * t("m2"), g1, g2


def delay_grid(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Mean validation error of ridges on two factors, each 0 to 3 slots back, over four folds; best: least error, then least delays.

    One aggregation gives the moments of every pair of delays, fold and role; fits and errors follow from these.
    """
    by = Window.partitionBy("series_id").orderBy("t_idx")
    back = lambda c: F.array(*[F.struct(F.lit(k).alias("d"), (F.lag(c, k).over(by) if k else F.col(c)).alias("x")) for k in range(MOST_DELAY + 1)])
    rows = _slots(spark, sf_dir, series).select("series_id", "ts", F.col("ntu").alias("y"), back("rw").alias("one"), back("alum").alias("two")).where("y is not null")
    roles = F.array(*[F.when(F.col("ts") < starts, F.struct(F.lit(k).alias("fold"), F.lit(True).alias("trains"))).when(F.col("ts") < ends, F.struct(F.lit(k).alias("fold"), F.lit(False).alias("trains"))) for k, (starts, ends) in enumerate(FOLD_DAYS, 1)])
    used = rows.select("*", F.explode("one").alias("a")).select("*", F.explode("two").alias("b")).where("a.x is not null and b.x is not null").withColumn("role", F.explode(F.filter(roles, lambda r: r.isNotNull())))
    pairs = used.select("series_id", F.col("a.d").alias("d1"), F.col("b.d").alias("d2"), "role.fold", "role.trains", F.col("a.x").alias("x1"), F.col("b.x").alias("x2"), "y")
    variance = {name: F.covar_pop(a, b).alias(name) for name, a, b in (("v1", "x1", "x1"), ("v2", "x2", "x2"), ("vy", "y", "y"), ("c12", "x1", "x2"), ("c1y", "x1", "y"), ("c2y", "x2", "y"))}
    moments = pairs.groupBy("series_id", "d1", "d2", "fold", "trains").agg(F.count("*").alias("n"), F.avg("x1").alias("m1"), F.avg("x2").alias("m2"), F.avg("y").alias("my"), *variance.values())
    names = ("n", "m1", "m2", "my", *variance)
    sides = moments.groupBy("series_id", "d1", "d2", "fold").agg(*[F.max(F.when(F.col("trains") == trains, F.struct(*names))).alias(side) for side, trains in (("t", True), ("v", False))])
    grid = sides.where("t.n > 1 and v.n > 0").withColumn("ridge", F.explode(F.array(*[F.lit(r) for r in RIDGES])))
    a, g1, g2 = _two_factor_fit(lambda c: F.col(f"t.{c}"), F.col("ridge"))
    fitted = grid.select("series_id", "d1", "d2", "ridge", "v", a.alias("a"), g1.alias("g1"), g2.alias("g2"))
    off = F.expr("a + g1 * v.m1 + g2 * v.m2 - v.my")
    spread = F.expr("v.vy + g1 * g1 * v.v1 + g2 * g2 * v.v2 + 2 * g1 * g2 * v.c12 - 2 * g1 * v.c1y - 2 * g2 * v.c2y")
    found = fitted.groupBy("series_id", "d1", "d2", "ridge").agg(F.round(F.avg(F.sqrt(F.greatest(off * off + spread, F.lit(0.0)))), 5).alias("rmse"))
    least = Window.partitionBy("series_id").orderBy("rmse", F.col("d1") + F.col("d2"), "d1", "d2", "ridge")  # 80 rows a series
    return found.withColumn("best", F.row_number().over(least) == 1)


def drawn_blocks(repeats: int, blocks: int) -> np.ndarray:
    """Blocks drawn by an integer congruence of draw and place, so that every engine draws alike."""
    rep, place = np.arange(repeats)[:, None], np.arange(blocks)[None, :]
    return (rep * 48271 + place * 69621 + 12345) * 16807 % 2147483647 % blocks


def bootstrap_spearman(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Rank correlation of three factors with the target, and its range over 200 draws of blocks of twelve complete rows."""
    found = block_intervals(_slots(spark, sf_dir, series), list(DRAWN), "ntu", 0, REPEATS, BLOCK, drawn_blocks)
    return found.withColumns({c: F.round(c, 6) for c in ("rho", "low", "high")})


QUERIES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (delay_grid, bootstrap_spearman)}

#: Sums over training (t) and validation (v) rows from which two-factor ridge fits follow.
MOMENTS = {"n": "1.0", "s1": "x1", "s2": "x2", "sy": "y", "s11": "x1 * x1", "s22": "x2 * x2", "s12": "x1 * x2", "s1y": "x1 * y", "s2y": "x2 * y", "syy": "y * y"}
_SUMS = ", ".join(f"sum(CASE WHEN {when} THEN CAST({what} AS DOUBLE) END) AS {role}_{name}" for role, when in (("t", "ts < starts"), ("v", "ts >= starts AND ts < ends")) for name, what in MOMENTS.items())
_PICK = ", ".join("CASE " + " ".join(f"WHEN {d} = {k} THEN {x}_lag{k}" for k in range(4)) + f" END AS {out}" for d, x, out in (("d1", "rw", "x1"), ("d2", "alum", "x2")))
_LAGS = ", ".join(f"lag({x}, {k}) {W} AS {x}_lag{k}" for x in ("rw", "alum") for k in range(4))

DELAYS = f"""WITH l AS (SELECT series_id, ts, ntu AS y, {_LAGS} FROM slots),
x AS (SELECT series_id, ts, y, d1, d2, {_PICK} FROM l CROSS JOIN (SELECT k AS d1 FROM {{taps}} WHERE k < 4) a CROSS JOIN (SELECT k AS d2 FROM {{taps}} WHERE k < 4) b),
m AS (SELECT series_id, d1, d2, fold, {_SUMS} FROM x CROSS JOIN {FOLDS} WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL GROUP BY series_id, d1, d2, fold),
c AS (SELECT *, t_s1 / t_n AS m1, t_s2 / t_n AS m2, t_sy / t_n AS my, sqrt(greatest(t_s11 / t_n - (t_s1 / t_n) * (t_s1 / t_n), 1e-20)) AS c1, sqrt(greatest(t_s22 / t_n - (t_s2 / t_n) * (t_s2 / t_n), 1e-20)) AS c2 FROM m WHERE t_n > 1 AND v_n > 0),
z AS (SELECT *, (t_s12 - t_n * m1 * m2) / c1 / c2 AS q12, (t_s1y - t_n * m1 * my) / c1 AS q1, (t_s2y - t_n * m2 * my) / c2 AS q2 FROM c),
b AS (SELECT *, ((t_n + ridge) * q1 - q12 * q2) / ((t_n + ridge) * (t_n + ridge) - q12 * q12) / c1 AS g1, ((t_n + ridge) * q2 - q12 * q1) / ((t_n + ridge) * (t_n + ridge) - q12 * q12) / c2 AS g2
      FROM z CROSS JOIN (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(1 AS DOUBLE)), (CAST(10 AS DOUBLE)), (CAST(100 AS DOUBLE))) AS g(ridge)),
i AS (SELECT *, my - g1 * m1 - g2 * m2 AS a FROM b),
r AS (SELECT series_id, d1, d2, ridge, avg(sqrt(greatest((v_syy - 2 * a * v_sy - 2 * g1 * v_s1y - 2 * g2 * v_s2y + v_n * a * a + 2 * a * g1 * v_s1 + 2 * a * g2 * v_s2 + g1 * g1 * v_s11 + g2 * g2 * v_s22 + 2 * g1 * g2 * v_s12) / v_n, 0))) AS rmse FROM i GROUP BY series_id, d1, d2, ridge)
SELECT series_id, d1, d2, ridge, round(rmse, 5) AS rmse, row_number() OVER (PARTITION BY series_id ORDER BY round(rmse, 5), d1 + d2, d1, d2, ridge) = 1 AS best FROM r"""

_LONG = " UNION ALL ".join(f"SELECT series_id, '{c}' AS factor, t_idx, {c} AS x, ntu AS y FROM slots WHERE {c} IS NOT NULL AND ntu IS NOT NULL" for c in DRAWN)


def _ranks(by: str) -> str:
    return ", ".join(f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 AS r{c}" for c in "xy")


BOOTSTRAP = f"""WITH long AS ({_LONG}),
v AS (SELECT *, (row_number() OVER (PARTITION BY series_id, factor ORDER BY t_idx) - 1) // {BLOCK} AS block, count(*) OVER (PARTITION BY series_id, factor) // {BLOCK} AS blocks FROM long),
n AS (SELECT DISTINCT series_id, factor, blocks FROM v),
places AS (SELECT series_id, factor, blocks, unnest(range(blocks)) AS place FROM n WHERE blocks >= 2),
d AS (SELECT series_id, factor, rep, (rep * 48271 + place * 69621 + 12345) * 16807 % 2147483647 % blocks AS block FROM places CROSS JOIN range({REPEATS}) AS t(rep)),
r AS (SELECT series_id, factor, rep, {_ranks("series_id, factor, rep")} FROM d JOIN v USING (series_id, factor, block)),
c AS (SELECT series_id, factor, rep, nullif(corr(rx, ry), 'NaN'::DOUBLE) AS rho FROM r GROUP BY series_id, factor, rep),
e AS (SELECT series_id, factor, percentile_cont(0.025) WITHIN GROUP (ORDER BY rho) AS low, percentile_cont(0.975) WITHIN GROUP (ORDER BY rho) AS high FROM c GROUP BY series_id, factor),
w AS (SELECT series_id, factor, nullif(corr(rx, ry), 'NaN'::DOUBLE) AS rho FROM (SELECT series_id, factor, {_ranks("series_id, factor")} FROM v) x GROUP BY series_id, factor)
SELECT series_id, factor, round(rho, 6) AS rho, round(low, 6) AS low, round(high, 6) AS high, CAST(blocks AS INTEGER) AS blocks FROM n LEFT JOIN w USING (series_id, factor) LEFT JOIN e USING (series_id, factor)"""

SQL = {"delay_grid": DELAYS, "bootstrap_spearman": BOOTSTRAP}
