"""Series queries as DataFrames, each with one pass over the slots; their SQL for DuckDB (series_sql) is written another way.

Everything is grouped or windowed by series, so series run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.calendar import ONE, regular_slots, slot_means
from oriel.sources import read_table

FIELDS = ("ntu", "filt", "rw", "ph", "alum", "flow", "k")
FACTORS = ("filt", "rw", "ph", "alum", "flow", "k")
BY = ("series_id",)
#: First slot that isn't trained on.
TRAIN_BEFORE = 240


def _slots(spark: SparkSession, sf_dir: str, series: str) -> DataFrame:
    return regular_slots(read_table(spark, sf_dir, "events"), series)


def _unpivot(rows: DataFrame, names: tuple[str, ...], *keep: str) -> DataFrame:
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in names])))


def timeline_gate(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Steps of the measured slots by their own clock, before any calendar fills them: how many aren't two hours, and the first of those."""
    own = slot_means(read_table(spark, sf_dir, "events"), series)
    step = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts", 1).over(Window.partitionBy(*BY).orderBy("ts")))) / 7200
    rows = own.withColumn("step", step)
    return rows.groupBy(*BY).agg(F.count("*").alias("slots"), F.count_distinct("ts").alias("distinct_slots"), F.count_if(F.col("step") != 1).alias("bad_steps"), F.date_format(F.min(F.when(F.col("step") != 1, F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("first_bad"))


def field_profile(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Rows, missing values, extremes and median of each field, from one aggregation."""
    one = lambda c: F.struct(F.lit(c).alias("field"), F.count("*").alias("total"), (F.count("*") - F.count(c)).alias("missing"), F.round(1 - F.count(c) / F.count("*"), 6).alias("missing_rate"), F.min(c).alias("minimum"), F.median(c).alias("median_value"), F.max(c).alias("maximum"))
    rows = _slots(spark, sf_dir, series).groupBy(*BY).agg(F.array(*[one(c) for c in FIELDS]).alias("all")).select(*BY, F.inline("all"))
    return rows.withColumns({c: F.round(c, 7) for c in ("minimum", "median_value", "maximum")})


def carry_back(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """The last known value at or before each slot, and where it was measured."""
    by = Window.partitionBy(*BY).orderBy("t_idx")
    return _slots(spark, sf_dir, series).select(*BY, "t_idx", "filt", F.last("filt", True).over(by).alias("carried"), F.last(F.when(F.col("filt").isNotNull(), F.col("t_idx")), True).over(by).alias("seen_at"))


def spearman_matrix(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Rank correlation of each factor with the target, ties ranked alike; one scan, ranks by series and factor."""
    rows = _unpivot(_slots(spark, sf_dir, series).where("ntu is not null"), FACTORS, *BY, "ntu").where("x is not null")
    average = lambda c: F.rank().over(Window.partitionBy(*BY, "factor").orderBy(c)) + (F.count("*").over(Window.partitionBy(*BY, "factor", c)) - 1) / 2
    return rows.select(*BY, "factor", average("x").alias("rx"), average("ntu").alias("ry")).groupBy(*BY, "factor").agg(F.round(F.corr("rx", "ry"), 6).alias("rho"), F.count("*").alias("n"))


def ks_two_sample(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Largest distance of the two distribution functions, and the asymptotic p-value (Kolmogorov's series)."""
    first = F.when(F.col("t_idx") < TRAIN_BEFORE, 1.0).otherwise(0.0)
    counts = _slots(spark, sf_dir, series).where("ntu is not null").groupBy(*BY, "ntu").agg(F.sum(first).alias("a"), F.sum(1 - first).alias("b"))
    upto, whole = Window.partitionBy(*BY).orderBy("ntu"), Window.partitionBy(*BY)
    rows = counts.select(*BY, *[(F.sum(c).over(upto) / F.sum(c).over(whole)).alias(f"f{c}") for c in "ab"], *[F.sum(c).over(whole).alias(f"n{c}") for c in "ab"])
    found = rows.groupBy(*BY).agg(F.max(F.abs(F.col("fa") - F.col("fb"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    at = F.col("d") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * at * at))
    return found.select(*BY, F.round("d", 6).alias("d_statistic"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)), 6).alias("p_asymptotic"))


def psi_drift(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Stability index of later against earlier values over the earlier tenths.

    Equal edges count once; null with under 20 values on a side or under 3 distinct edges, the
    outer two included.
    """
    tenths = [k / 10 for k in range(11)]
    early = F.col("t_idx") < TRAIN_BEFORE
    slots = _slots(spark, sf_dir, series).where("ntu is not null")
    edges = slots.groupBy(*BY).agg(F.percentile(F.when(early, F.col("ntu")), F.array(*[F.lit(p) for p in tenths])).alias("e")).select(*BY, F.array_distinct(F.transform("e", lambda x: F.round(x, 9))).alias("edges"))
    inner = F.expr("slice(edges, 2, greatest(size(edges) - 2, 0))")
    binned = slots.join(edges, list(BY)).select(*BY, F.size("edges").alias("n_edges"), early.alias("early"), F.size(F.filter(inner, lambda e: e <= F.round(F.col("ntu"), 9))).alias("bin"))
    bins = binned.groupBy(*BY, "n_edges", "bin").agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b"))
    whole = Window.partitionBy(*BY)
    share = bins.select(*BY, "n_edges", F.sum("a").over(whole).alias("na"), F.sum("b").over(whole).alias("nb"), "a", "b")
    p, q = (F.greatest(F.col(x) / F.col(f"n{x}"), F.lit(1e-6)) for x in "ab")
    # Bins without any value add (eps - eps) * ln(1) = 0.
    return share.groupBy(*BY).agg(F.when((F.max("na") >= 20) & (F.max("nb") >= 20) & (F.max("n_edges") >= 3), F.round(F.sum((q - p) * F.log(q / p)), 6)).alias("psi"))


def _recent(slots: DataFrame, taps: int) -> DataFrame:
    """slots with y (the target) and v: the last `taps` values of rw, its median for gaps, the current one last."""
    middle = slots.groupBy(*BY).agg(F.median("rw").alias("_mid"))
    filled = slots.join(middle, list(BY)).withColumn("x", F.coalesce("rw", "_mid"))
    return filled.withColumn("v", F.collect_list("x").over(Window.partitionBy(*BY).orderBy("t_idx").rowsBetween(1 - taps, 0)))


def _kernel(v: str, weights: np.ndarray) -> Column:
    """Weighted sum of the array v from its end back; what lies before the series is its first value."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.transform(w, lambda x, k: x * F.get(F.col(v), F.greatest(F.size(v) - 1 - k, F.lit(0)))), F.lit(0.0), lambda s, x: s + x)


def fir_convolve(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """A geometric kernel of 12 taps over the last values, with the series' head held."""
    w = np.exp(-0.25 * np.arange(12))
    return _recent(_slots(spark, sf_dir, series), 12).select(*BY, "t_idx", F.round(_kernel("v", w / w.sum()), 6).alias("physical"))


def zero_head_convolve(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """The same kernel with zeros before the series."""
    w = np.exp(-0.25 * np.arange(12))
    padded = F.concat(F.array_repeat(F.lit(0.0), 12), F.col("v"))
    return _recent(_slots(spark, sf_dir, series), 12).withColumn("v", padded).select(*BY, "t_idx", F.round(_kernel("v", w / w.sum()), 6).alias("physical"))


def skill_ratios(spark: SparkSession, sf_dir: str, series: str = ONE) -> DataFrame:
    """Seasonal naive against persistence: error over the deviation of the target, ratio of deviations, and 1 - (rmse / base) ** 2."""
    by = Window.partitionBy(*BY).orderBy("t_idx")
    rows = _slots(spark, sf_dir, series).select(*BY, F.col("ntu").alias("y"), F.lag("ntu", 12).over(by).alias("p"), F.lag("ntu", 1).over(by).alias("b")).where("y is not null and p is not null and b is not null")
    rmse = lambda c: F.sqrt(F.avg((F.col(c) - F.col("y")) ** 2))
    return rows.groupBy(*BY).agg(F.round(F.stddev_pop("p") / F.stddev_pop("y"), 6).alias("std_ratio"), F.round(rmse("p") / F.stddev_pop("y"), 6).alias("rmse_to_sigma"), F.round(1 - (rmse("p") / rmse("b")) ** 2, 6).alias("skill"))


QUERIES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (timeline_gate, field_profile, carry_back, spearman_matrix, ks_two_sample, psi_drift, fir_convolve, zero_head_convolve, skill_ratios)}

_W = "OVER (PARTITION BY series_id ORDER BY t_idx)"
#: For DuckDB, after the slots: joins and unions where the queries above read arrays and windows.
SQL = {
    "timeline_gate": "SELECT series_id, CAST(count(*) AS BIGINT) AS slots, CAST(count(DISTINCT ts) AS BIGINT) AS distinct_slots, CAST(count(*) FILTER (WHERE earlier IS NOT NULL AND ts - earlier <> INTERVAL '2 hours') AS BIGINT) AS bad_steps, strftime(min(ts) FILTER (WHERE earlier IS NOT NULL AND ts - earlier <> INTERVAL '2 hours'), '%Y-%m-%d %H:%M:%S') AS first_bad FROM (SELECT m.series_id, m.ts, (SELECT max(b.ts) FROM means b WHERE b.series_id = m.series_id AND b.ts < m.ts) AS earlier FROM means m) x GROUP BY series_id",
    "field_profile": " UNION ALL ".join(f"SELECT series_id, '{c}' AS field, CAST(count(*) AS BIGINT) AS total, CAST(count(*) - count({c}) AS BIGINT) AS missing, round(1 - count({c}) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, round(min({c}), 7) AS minimum, round(median({c}), 7) AS median_value, round(max({c}), 7) AS maximum FROM slots GROUP BY series_id" for c in FIELDS),
    "carry_back": "SELECT a.series_id, a.t_idx, a.filt, b.filt AS carried, b.t_idx AS seen_at FROM slots a ASOF LEFT JOIN (SELECT * FROM slots WHERE filt IS NOT NULL) b ON a.series_id = b.series_id AND a.t_idx >= b.t_idx",
    "spearman_matrix": " UNION ALL ".join(f"SELECT series_id, '{c}' AS factor, round(corr(rx, ry), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM (SELECT a.series_id, (SELECT count(*) FILTER (WHERE b.{c} < a.{c}) + count(*) FILTER (WHERE b.{c} = a.{c}) / 2.0 FROM slots b WHERE b.series_id = a.series_id AND b.ntu IS NOT NULL) AS rx, (SELECT count(*) FILTER (WHERE b.ntu < a.ntu) + count(*) FILTER (WHERE b.ntu = a.ntu) / 2.0 FROM slots b WHERE b.series_id = a.series_id AND b.{c} IS NOT NULL) AS ry FROM slots a WHERE a.{c} IS NOT NULL AND a.ntu IS NOT NULL) x GROUP BY series_id" for c in FACTORS),
    "ks_two_sample": "WITH v AS (SELECT series_id, ntu, t_idx < 240 AS early FROM slots WHERE ntu IS NOT NULL), n AS (SELECT series_id, CAST(count(*) FILTER (WHERE early) AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE NOT early) AS DOUBLE) AS nb FROM v GROUP BY series_id), f AS (SELECT a.series_id, a.ntu, na, nb, abs(count(*) FILTER (WHERE b.early) / na - count(*) FILTER (WHERE NOT b.early) / nb) AS gap FROM (SELECT DISTINCT series_id, ntu FROM v) a JOIN v b ON b.ntu <= a.ntu AND a.series_id = b.series_id JOIN n ON n.series_id = a.series_id GROUP BY a.series_id, a.ntu, na, nb), d AS (SELECT series_id, max(gap) AS d, max(gap) * max(gap) * max(na) * max(nb) / (max(na) + max(nb)) AS z FROM f GROUP BY series_id) SELECT series_id, round(d, 6) AS d_statistic, round(least(1, greatest(0, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * z)) FROM generate_series(1, 100) AS g(k)))), 6) AS p_asymptotic FROM d",
    "psi_drift": "WITH e AS (" + " UNION ALL ".join(f"SELECT series_id, {k} AS j, round(percentile_cont({k / 10}) WITHIN GROUP (ORDER BY ntu), 9) AS edge FROM slots WHERE t_idx < 240 GROUP BY series_id" for k in range(11)) + "), u AS (SELECT DISTINCT series_id, edge FROM e), i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY edge) AS place, count(*) OVER (PARTITION BY series_id) AS n_edges FROM u), b AS (SELECT s.series_id, s.t_idx, max(n_edges) AS n_edges, count(*) FILTER (WHERE place > 1 AND place < n_edges AND edge <= round(ntu, 9)) AS bin FROM slots s JOIN i ON i.series_id = s.series_id WHERE ntu IS NOT NULL GROUP BY s.series_id, s.t_idx), c AS (SELECT series_id, bin, max(n_edges) AS n_edges, CAST(count(*) FILTER (WHERE t_idx < 240) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE t_idx >= 240) AS DOUBLE) AS b FROM b GROUP BY series_id, bin), n AS (SELECT series_id, sum(a) AS na, sum(b) AS nb FROM c GROUP BY series_id) SELECT c.series_id, CASE WHEN max(na) >= 20 AND max(nb) >= 20 AND max(n_edges) >= 3 THEN round(sum((greatest(b / nb, 0.000001) - greatest(a / na, 0.000001)) * ln(greatest(b / nb, 0.000001) / greatest(a / na, 0.000001))), 6) END AS psi FROM c JOIN n ON n.series_id = c.series_id GROUP BY c.series_id",
    "fir_convolve": "WITH w AS (SELECT k, exp(-0.25 * k) / sum(exp(-0.25 * k)) OVER () AS weight FROM generate_series(0, 11) AS g(k)), m AS (SELECT series_id, median(rw) AS mid FROM slots GROUP BY series_id), c AS (SELECT s.series_id, t_idx, coalesce(rw, mid) AS x FROM slots s JOIN m ON m.series_id = s.series_id) SELECT a.series_id, a.t_idx, round(sum(w.weight * b.x), 6) AS physical FROM c a CROSS JOIN w JOIN c b ON b.series_id = a.series_id AND b.t_idx = greatest(a.t_idx - w.k, 0) GROUP BY a.series_id, a.t_idx",
    "zero_head_convolve": "WITH w AS (SELECT k, exp(-0.25 * k) / sum(exp(-0.25 * k)) OVER () AS weight FROM generate_series(0, 11) AS g(k)), m AS (SELECT series_id, median(rw) AS mid FROM slots GROUP BY series_id), c AS (SELECT s.series_id, t_idx, coalesce(rw, mid) AS x FROM slots s JOIN m ON m.series_id = s.series_id) SELECT a.series_id, a.t_idx, round(sum(w.weight * coalesce(b.x, 0)), 6) AS physical FROM c a CROSS JOIN w LEFT JOIN c b ON b.series_id = a.series_id AND b.t_idx = a.t_idx - w.k GROUP BY a.series_id, a.t_idx",
    "skill_ratios": f"WITH r AS (SELECT series_id, ntu AS y, lag(ntu, 12) {_W} AS p, lag(ntu) {_W} AS b FROM slots) SELECT series_id, round(sqrt(avg(p * p) - avg(p) * avg(p)) / sqrt(avg(y * y) - avg(y) * avg(y)), 6) AS std_ratio, round(sqrt(avg((p - y) * (p - y))) / sqrt(avg(y * y) - avg(y) * avg(y)), 6) AS rmse_to_sigma, round(1 - avg((p - y) * (p - y)) / avg((b - y) * (b - y)), 6) AS skill FROM r WHERE y IS NOT NULL AND p IS NOT NULL AND b IS NOT NULL GROUP BY series_id",
}
