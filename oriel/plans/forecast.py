"""Queries of the residual forecast: state vectors, physical forecasts, models by horizon, backtest, paths and scenarios.

SQL for DuckDB is written another way than the operators: it joins rows with taps and earlier
rows where these read a window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.operators.calendar import SLOTS_SQL, regular_slots
from oriel.operators.grids import Grid, Share, mean_errors
from oriel.operators.horizons import backtest, fan, fill_gaps_by_model, gate_vectors, horizon_models, horizon_samples, joint_errors, path_grades, scenario_forecasts, simulate_paths, with_filled
from oriel.operators.state import HORIZONS, STATE_NAMES, TAPS, kernel, with_baselines, with_physical, with_state
from oriel.session import stage
from oriel.sources import read_table

#: Validation folds and ends of training, in slots.
FOLDS = ((120, 150), (150, 180), (180, 210), (210, 240))
TAUS = tuple(range(2, 25, 2))
ENDS = {"interim": 200, "final": 273}
#: Three operating days that are forecast freely, and where observed values are tested against again.
FREE, TEST_FROM = (273, 309), 309
LEAST_VECTORS, PATHS = 20, 500
#: The days' first slots, and the slots twelve hours before the days' first seven.
ORIGINS = (273, 285, 297)
DESIGNATED = tuple(start + k - 6 for start in ORIGINS for k in range(7))
SCENARIOS = (("rw +25%", "rw", 0.25), ("rw +100%", "rw", 1.0), ("alum +10%", "alum", 0.1), ("alum -10%", "alum", -0.1))


def _states(spark: SparkSession, sf_dir: str, **override) -> DataFrame:
    return with_state(with_physical(regular_slots(read_table(spark, sf_dir, "events"))), override=override)


def physical_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline of each slot and its forecasts one to six steps ahead."""
    rows = with_physical(regular_slots(read_table(spark, sf_dir, "events")))
    return rows.select("series_id", "t_idx", *[F.round(c, 7).alias(c) for c in ("tau", "physical", *(f"ahead{h}" for h in HORIZONS))])


def kernel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel of each slot, by its own time constant: weights of the taps, which add up to one."""
    rows = with_physical(regular_slots(read_table(spark, sf_dir, "events"))).select("series_id", "t_idx", "tau", F.explode(F.sequence(F.lit(0), F.lit(TAPS - 1))).alias("lag_steps"))
    return rows.withColumn("weight", F.round(kernel("tau", "lag_steps"), 6)).where("weight is not null").select("series_id", "t_idx", F.col("lag_steps").cast("long").alias("lag_steps"), "weight")


def tau_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean validation error, over four folds, of a ridge (0.1) on the logarithm of the baseline of each of 12 time constants.

    Every row's kernel follows its own level and flow. The target's logarithm is learnt, its own
    error counts; of equal errors the smaller time constant is best.
    """
    rows = with_baselines(regular_slots(read_table(spark, sf_dir, "events")), TAUS, FOLDS[0][0])
    cell = F.when(F.col("t_idx") < FOLDS[0][0], 0)
    for k, (_, end) in enumerate(FOLDS):
        cell = cell.when(F.col("t_idx") < end, k + 1)
    grid = Grid(stage(rows, "baselines"), cell, F.log1p("ntu"), F.col("ntu"), [F.log1p(f"physical_{t}") for t in TAUS])
    makes = {t: _only(k) for k, t in enumerate(TAUS)}
    found = mean_errors([(t, Share(k, make)) for t, make in makes.items() for k in range(1, len(FOLDS) + 1)], (0.1,), grid)
    best = min((e, t) for (t, _), e in found.items()) if found else None
    return spark.createDataFrame([(t, round(e, 5), (e, t) == best) for (t, _), e in found.items()], "tau long, rmse double, best boolean")


def _only(k: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: x[:, [k]]


def state_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 columns of the state vector."""
    return _states(spark, sf_dir).select("series_id", "t_idx", *[F.round(c, 6).alias(c) for c in STATE_NAMES], "available")


def scenario_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw turbidity doubled at the slot itself: what of the state vector changes."""
    rows = _states(spark, sf_dir, rw=F.col("rw") * 2)
    return rows.select("series_id", "t_idx", *[F.round(c, 6).alias(c) for c in ("log_rw", "log_rw_lag1", "delta_log_rw")])


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    states = stage(_states(spark, sf_dir), "states")
    samples = stage(horizon_samples(states), "samples")
    models = stage(horizon_models(samples, FOLDS, ENDS), "models")
    errors = stage(gate_vectors(joint_errors(samples, models, ENDS["interim"], ENDS["final"]), LEAST_VECTORS), "errors")
    return states, samples, models, errors


def horizon_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen ridge of each horizon, its error over the folds, and the final model's weights."""
    samples = horizon_samples(_states(spark, sf_dir))
    found = horizon_models(stage(samples, "samples"), FOLDS, ENDS).where("model = 'final'")
    width = len(STATE_NAMES)
    return found.select("series_id", "horizon", "ridge", "rmse", F.slice("numbers", 5 * width + 1, width).alias("weights"), F.element_at("numbers", -1).alias("intercept"))


def _filled(states: DataFrame, models: DataFrame) -> DataFrame:
    """States with gaps and the free days filled by the model."""
    return stage(with_filled(states, fill_gaps_by_model(states, models, free=FREE)), "filled")


def horizon_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid, persistence and physical forecasts against what came, by horizon, from origins after the free days; residuals and values of these and of gaps are the model's."""
    states, _, models, errors = _fitted(spark, sf_dir)
    filled = _filled(states, models)
    rows = horizon_samples(filled).drop("persisted").join(filled.select("series_id", "t_idx", F.col("filled").alias("persisted")), ["series_id", "t_idx"])
    return backtest(rows, models, errors, TEST_FROM)


def model_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target with gaps and three free days filled by one-step forecasts from the filled state."""
    states, _, models, _ = _fitted(spark, sf_dir)
    return fill_gaps_by_model(states, models, free=FREE).select("series_id", "t_idx", "filled")


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    states, _, models, errors = _fitted(spark, sf_dir)
    origins = tuple(sorted({*ORIGINS, *DESIGNATED}))
    return states, stage(simulate_paths(_filled(states, models), models, errors, FREE[0], 330, PATHS, origins), "paths")


def forecast_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95 % range of 500 paths, 1 to 12 hours after the first slot of each of three days."""
    return fan(_paths(spark, sf_dir)[1], ORIGINS)


def designated_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve-hour forecasts of the first seven slots of three days beside the physical forecast, and what the residual model adds; no target is needed."""
    states, paths = _paths(spark, sf_dir)
    q = paths.where(F.col("t_idx").isin(*DESIGNATED) & (F.col("horizon") == 6)).groupBy("series_id", "t_idx").agg(F.percentile("y", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"), F.count("*").alias("paths"))
    both = q.join(states.select("series_id", "t_idx", F.col("ahead6").alias("hydraulic")), ["series_id", "t_idx"])
    return both.select("series_id", "t_idx", (F.col("t_idx") + 6).alias("at"), *[F.col("q")[k].alias(c) for k, c in enumerate(("low", "mid", "high"))], "hydraulic", (F.col("q")[1] - F.col("hydraulic")).alias("correction"), "paths")


def grade_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities, modal grade and 95 % range of grades of each simulated day."""
    states, paths = _paths(spark, sf_dir)
    days = paths.where("horizon = 1").select("series_id", "path", (F.col("t_idx") + 1).alias("t_idx"), "y").join(states.select("series_id", "t_idx", "op_day"), ["series_id", "t_idx"])
    return path_grades(days)


def scenario_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each of four scenarios changes the hybrid forecasts from three origins, and the elasticity: 72 rows a series."""
    states, _, models, _ = _fitted(spark, sf_dir)
    return scenario_forecasts(_filled(states, models), models, ORIGINS, SCENARIOS)


#: Taps and their sources joined row by row.
PHYSICAL_SQL = f"""WITH {SLOTS_SQL},
mids AS (SELECT series_id, median(ph) FILTER (WHERE t_idx < 240) AS ml, median(flow) FILTER (WHERE t_idx < 240) AS mf, median(filt) AS mm FROM slots GROUP BY series_id),
tau AS (SELECT s.series_id, t_idx, filt, mm, greatest(2.0, least(24.0, 8.0 * coalesce(ph / ml, 1.0) / coalesce(CASE WHEN flow > 0 THEN flow END / mf, 1.0))) AS tau,
  (SELECT arg_max(b.filt, b.t_idx) FROM slots b WHERE b.series_id = s.series_id AND b.t_idx <= s.t_idx AND b.filt IS NOT NULL) AS last FROM slots s JOIN mids m ON m.series_id = s.series_id),
taps AS (SELECT *, unnest(range(CAST(ceil(round(ln(0.05) * tau / -2, 9)) AS BIGINT))) AS tap FROM tau),
weights AS (SELECT *, exp(-2 / tau * tap) / sum(exp(-2 / tau * tap)) OVER (PARTITION BY series_id, t_idx) AS w FROM taps),
sourced AS (SELECT w.*, h, CASE WHEN h > tap THEN w.last ELSE coalesce(b.filt, CASE WHEN h = 0 THEN coalesce(w.filt, mm) ELSE w.last END) END AS v
  FROM weights w CROSS JOIN generate_series(0, 6) AS g(h) LEFT JOIN slots b ON b.series_id = w.series_id AND b.t_idx = greatest(w.t_idx + h - tap, 0)),
summed AS (SELECT series_id, t_idx, h, max(tau) AS tau, CASE WHEN h = 0 OR max(last) IS NOT NULL THEN sum(w * v) END AS made FROM sourced GROUP BY series_id, t_idx, h),
physical AS (SELECT series_id, t_idx, max(tau) AS tau, max(made) FILTER (WHERE h = 0) AS physical, {', '.join(f'max(made) FILTER (WHERE h = {h}) AS ahead{h}' for h in HORIZONS)} FROM summed GROUP BY series_id, t_idx)
"""
_BACK = ", ".join(f"r{k}.residual AS residual_lag{k}" for k in range(6))
_JOINS = " ".join(f"LEFT JOIN residuals r{k} ON r{k}.series_id = s.series_id AND r{k}.t_idx = s.t_idx - {k}" for k in range(6))


def _state_sql(rw: str) -> str:
    return f"""{PHYSICAL_SQL},
residuals AS (SELECT s.*, ln(1 + ntu) - ln(1 + physical) AS residual FROM slots s JOIN physical p ON p.series_id = s.series_id AND p.t_idx = s.t_idx),
state AS (SELECT s.series_id, s.t_idx, {_BACK}, ln(1 + s.filt) AS log_filt, ln(1 + b.filt) AS log_filt_lag1, ln(1 + s.filt) - ln(1 + b.filt) AS delta_log_filt,
  ln(1 + {rw}) AS log_rw, ln(1 + b.rw) AS log_rw_lag1, ln(1 + {rw}) - ln(1 + b.rw) AS delta_log_rw, s.alum, s.k AS rw_flow, s.flow AS tw_flow, s.ph AS level,
  CAST(s.alum IS NULL AS DOUBLE) AS alum_missing, CAST(s.k IS NULL AS DOUBLE) AS rw_flow_missing, CAST(s.flow IS NULL AS DOUBLE) AS tw_flow_missing, CAST(s.ph IS NULL AS DOUBLE) AS level_missing,
  sin(2 * pi() * hour(s.ts) / 24) AS hour_sin, cos(2 * pi() * hour(s.ts) / 24) AS hour_cos, sin(2 * pi() * dayofyear(s.ts) / 365.25) AS year_sin, cos(2 * pi() * dayofyear(s.ts) / 365.25) AS year_cos,
  {' AND '.join(f'r{k}.residual IS NOT NULL' for k in range(6))} AS available
  FROM residuals s {_JOINS} LEFT JOIN slots b ON b.series_id = s.series_id AND b.t_idx = s.t_idx - 1)
"""


def _rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names)


#: Full baselines by joins, then each fold's fit from its moments.
TAU_SQL = f"""WITH {SLOTS_SQL},
mids AS (SELECT series_id, median(ph) FILTER (WHERE t_idx < {FOLDS[0][0]}) AS ml, median(flow) FILTER (WHERE t_idx < {FOLDS[0][0]}) AS mf, median(filt) AS mm FROM slots GROUP BY series_id),
tau AS (SELECT s.series_id, t_idx, filt, ntu, mm, base, greatest(2.0, least(24.0, base * coalesce(ph / ml, 1.0) / coalesce(CASE WHEN flow > 0 THEN flow END / mf, 1.0))) AS tau FROM slots s JOIN mids m ON m.series_id = s.series_id CROSS JOIN range(2, 25, 2) AS g(base)),
taps AS (SELECT *, unnest(range(CAST(ceil(round(ln(0.05) * tau / -2, 9)) AS BIGINT))) AS tap FROM tau),
made AS (SELECT w.series_id, w.t_idx, w.base, max(w.ntu) AS ntu, ln(1 + sum(exp(-2 / w.tau * w.tap) * coalesce(b.filt, w.filt, w.mm)) / sum(exp(-2 / w.tau * w.tap))) AS x
  FROM taps w JOIN slots b ON b.series_id = w.series_id AND b.t_idx = greatest(w.t_idx - w.tap, 0) GROUP BY w.series_id, w.t_idx, w.base),
rows_of AS (SELECT base, t_idx, x, ntu, ln(1 + ntu) AS y FROM made WHERE ntu IS NOT NULL),
folds AS (SELECT * FROM (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(FOLDS))}) AS f(fold, starts, ends)),
bounds AS (SELECT base, fold, starts, ends, quantile_cont(x, 0.005) AS low, quantile_cont(x, 0.995) AS high FROM rows_of JOIN folds ON t_idx < starts GROUP BY ALL),
cut AS (SELECT r.base, fold, starts, ends, t_idx, ntu, y, least(greatest(x, low), high) AS c FROM rows_of r JOIN bounds b ON b.base = r.base),
fits AS (SELECT base, fold, avg(c) AS mc, CASE WHEN stddev_pop(c) < 1e-10 THEN 1.0 ELSE stddev_pop(c) END AS sc, avg(y) AS my, covar_pop(c, y) * count(*) / (CASE WHEN stddev_pop(c) < 1e-10 THEN 1.0 ELSE stddev_pop(c) END) / (count(*) * (CASE WHEN stddev_pop(c) < 1e-10 THEN 0 ELSE 1 END) + 0.1) AS w FROM cut WHERE t_idx < starts GROUP BY base, fold),
errors AS (SELECT c.base, c.fold, sqrt(avg(pow(greatest(0, exp(my + w * (c - mc) / sc) - 1) - ntu, 2))) AS rmse FROM cut c JOIN fits f ON f.base = c.base AND f.fold = c.fold WHERE t_idx >= starts AND t_idx < ends GROUP BY c.base, c.fold),
averaged AS (SELECT base, avg(rmse) AS rmse FROM errors GROUP BY base)
SELECT CAST(base AS BIGINT) AS tau, round(rmse, 5) AS rmse, row_number() OVER (ORDER BY rmse, base) = 1 AS best FROM averaged"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (physical_forecast, kernel_table, tau_search, state_features, scenario_states, horizon_ridges, horizon_backtest, model_gap_fill, forecast_fan, designated_forecasts, grade_ranges, scenario_sensitivity)
}
ORACLES = {
    "kernel_table": f"{PHYSICAL_SQL} SELECT series_id, t_idx, tap AS lag_steps, round(w, 6) AS weight FROM weights",
    "tau_search": TAU_SQL,
    "physical_forecast": f"{PHYSICAL_SQL} SELECT series_id, t_idx, {_rounded(["tau", "physical", *(f"ahead{h}" for h in HORIZONS)], 7)} FROM physical",
    "state_features": f"{_state_sql('s.rw')} SELECT series_id, t_idx, {_rounded(STATE_NAMES)}, available FROM state",
    "scenario_states": f"{_state_sql('(2 * s.rw)')} SELECT series_id, t_idx, {_rounded(['log_rw', 'log_rw_lag1', 'delta_log_rw'])} FROM state",
}
