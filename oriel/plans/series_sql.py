"""Queries over the slots of an event log, as SQL that Spark and DuckDB read alike.

{s} stands for the slots. Windows are partitioned by series, so many series run side by side.
Floats are rounded to six decimals or fewer, as engines add up in different orders.
"""

W = "OVER (PARTITION BY series_id ORDER BY t_idx)"
#: A mean of millionths as whole numbers: the same to the last bit in whatever order they are added.
MEAN = "CAST(sum(CAST(round(ntu * 1000000) AS BIGINT)) AS DOUBLE) / nullif(count(ntu), 0) / 1000000"


def _lags(names: tuple[str, ...], steps: tuple[int, ...]) -> str:
    return ", ".join(f"lag({c}, {k}) {W} AS {c}_lag{k}" if k else f"{c} AS {c}_lag0" for c in names for k in steps)


def _metrics(actual: str, predicted: str) -> str:
    """Root mean square error, mean absolute error and r2 (null for a constant actual) over complete rows."""
    return f"""round(sqrt(avg(({predicted} - {actual}) * ({predicted} - {actual}))), 6) AS rmse, round(avg(abs({predicted} - {actual})), 6) AS mae,
        CASE WHEN max({actual}) > min({actual}) THEN round(1 - sum(({predicted} - {actual}) * ({predicted} - {actual})) / (var_pop({actual}) * count(*)), 6) END AS r2, CAST(count(*) AS BIGINT) AS n"""


#: Starts and ends of the four validation folds.
FOLD_DAYS = tuple((f"2024-01-{d} 00:00:00", f"2024-01-{d + 3} 00:00:00") for d in (16, 19, 22, 25))
FOLDS = "(VALUES " + ", ".join(f"({k}, CAST('{a}' AS {{ntz}}), CAST('{b}' AS {{ntz}}))" for k, (a, b) in enumerate(FOLD_DAYS, 1)) + ") AS f(fold, starts, ends)"

SERIES_SQL: dict[str, str] = {
    "slots_regular": "SELECT t_idx, CAST(ts AS STRING) AS slot, op_day, n, ntu, filt, rw, ph, alum, flow, k FROM {s}",
    "lag_features": f"SELECT t_idx, {_lags(('ntu', 'filt', 'rw', 'alum'), (0, 1, 2, 3, 6))} FROM {{s}}",
    "lead_targets": f"SELECT t_idx, {', '.join(f'lead(ntu, {h}) {W} AS ntu_h{h}' for h in range(1, 7))} FROM {{s}}",
    "diff_features": f"SELECT t_idx, round(ntu - lag(ntu) {W}, 6) AS d_ntu, round(ln(1 + filt) - lag(ln(1 + filt)) {W}, 6) AS d_log_filt, CASE WHEN alum IS NULL THEN 1 ELSE 0 END AS alum_missing FROM {{s}}",
    "cyclic_features": "SELECT t_idx, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) AS year_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS year_cos FROM {s}",
    # Products of millionths as whole numbers, so that both engines have the same to the last bit.
    "poly_interactions": f"SELECT t_idx, x, CAST(xi * xi AS DOUBLE) / 1e12 AS x_squared, CAST(xi * ai AS DOUBLE) / 1e12 AS x_alum, CAST(pi * ai AS DOUBLE) / 1e12 AS ph_alum FROM (SELECT t_idx, x, CAST(round(x * 1000000) AS BIGINT) AS xi, CAST(round(alum * 1000000) AS BIGINT) AS ai, CAST(round(ph * 1000000) AS BIGINT) AS pi FROM (SELECT t_idx, lag(rw, 1) {W} AS x, alum, ph FROM {{s}}) z) y",
    "inverse_link": "SELECT t_idx, CASE WHEN ntu IS NOT NULL THEN round(greatest(0.0, exp(ln(1 + ntu) - 0.1) - 1), 5) END AS back FROM {s}",
    "winsor_standardise": """WITH p AS (SELECT percentile_cont(0.005) WITHIN GROUP (ORDER BY ntu) AS lo, percentile_cont(0.995) WITHIN GROUP (ORDER BY ntu) AS hi, median(ntu) AS mid FROM {s} WHERE t_idx < 240),
        c AS (SELECT t_idx, least(greatest(coalesce(ntu, mid), lo), hi) AS x FROM {s} CROSS JOIN p),
        m AS (SELECT avg(x) AS mean_x, CASE WHEN stddev_pop(x) < 1e-10 THEN 1 ELSE stddev_pop(x) END AS sd_x FROM c WHERE t_idx < 240)
        SELECT t_idx, round((x - mean_x) / sd_x, 6) AS z FROM c CROSS JOIN m""",
    "fold_roles": f"SELECT fold, CAST(sum(CASE WHEN ts < starts THEN 1 ELSE 0 END) AS BIGINT) AS train, CAST(sum(CASE WHEN ts >= starts AND ts < ends THEN 1 ELSE 0 END) AS BIGINT) AS valid FROM {{s}} CROSS JOIN {FOLDS} GROUP BY fold",
    "state_available": "SELECT t_idx, CAST(count(filt) OVER (PARTITION BY series_id ORDER BY t_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) = 6 AS available FROM {s}",
    "seasonal_naive_metrics": f"SELECT {_metrics('y', 'p')} FROM (SELECT ntu AS y, lag(ntu, 12) {W} AS p FROM {{s}}) x WHERE y IS NOT NULL AND p IS NOT NULL",
    "bias_decomposition": f"SELECT round(avg(e) * avg(e), 6) AS bias_squared, round(var_pop(e), 6) AS dispersion, round(avg(e * e), 6) AS mse, round(avg(e) * avg(e) / avg(e * e), 6) AS bias_share FROM (SELECT lag(ntu, 12) {W} - ntu AS e FROM {{s}}) x WHERE e IS NOT NULL",
    "interval_coverage": f"WITH e AS (SELECT t_idx, ntu, lag(ntu) {W} AS p FROM {{s}}), q AS (SELECT percentile_cont(0.025) WITHIN GROUP (ORDER BY ntu - p) AS lo, percentile_cont(0.975) WITHIN GROUP (ORDER BY ntu - p) AS hi FROM e WHERE t_idx < 240 AND ntu IS NOT NULL AND p IS NOT NULL) SELECT round(avg(CASE WHEN ntu - p BETWEEN lo AND hi THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS coverage, CAST(count(*) AS BIGINT) AS n FROM e CROSS JOIN q WHERE t_idx >= 240 AND ntu IS NOT NULL AND p IS NOT NULL",
    "ljung_box": f"WITH r AS (SELECT series_id, t_idx, ntu - lag(ntu) {W} AS e FROM {{s}}), c AS (SELECT series_id, t_idx, e - avg(e) OVER (PARTITION BY series_id) AS c FROM r WHERE e IS NOT NULL), l AS (SELECT c, {', '.join(f'lag(c, {k}) {W} AS c{k}' for k in range(1, 13))} FROM c), a AS (SELECT count(*) AS n, sum(c * c) AS v, {', '.join(f'sum(c * c{k}) AS s{k}' for k in range(1, 13))} FROM l), q AS (SELECT n * (n + 2.0) * ({' + '.join(f'(s{k} / v) * (s{k} / v) / (n - {k})' for k in range(1, 13))}) / 2 AS h FROM a) SELECT round(2 * h, 5) AS q12, round(exp(-h) * (1 + h + h * h / 2 + h * h * h / 6 + h * h * h * h / 24 + h * h * h * h * h / 120), 9) AS p_value FROM q",
    "describe_windows": f"SELECT CASE WHEN t_idx < 240 THEN 'train' ELSE 'test' END AS part, CAST(count(ntu) AS BIGINT) AS n, {MEAN} AS mean_value, round(stddev_samp(ntu), 6) AS sd, round(percentile_cont(0.05) WITHIN GROUP (ORDER BY ntu), 6) AS p5, round(median(ntu), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY ntu), 6) AS p95, round(min(ntu), 6) AS minimum, round(max(ntu), 6) AS maximum FROM {{s}} GROUP BY CASE WHEN t_idx < 240 THEN 'train' ELSE 'test' END",
    "mode_degeneracy": "WITH v AS (SELECT n AS x, count(*) AS c FROM {s} GROUP BY n), m AS (SELECT median(n) AS mid FROM {s}), d AS (SELECT 1.4826 * median(abs(n - mid)) AS robust_scale FROM {s} CROSS JOIN m) SELECT CAST(count(*) AS BIGINT) AS distinct_values, round(max(c) / CAST(sum(c) AS DOUBLE), 6) AS mode_share, max(round(robust_scale, 6)) AS robust_scale, max(c) / CAST(sum(c) AS DOUBLE) >= 0.9 OR count(*) = 1 AS degenerate FROM v CROSS JOIN d",
    "pivot_min_matrix": "SELECT hour(ts) AS slot_hour, " + ", ".join(f"round(min(CASE WHEN (t_idx / 12) - floor(t_idx / 48) * 4 >= {d} AND (t_idx / 12) - floor(t_idx / 48) * 4 < {d + 1} THEN ntu END), 6) AS d{d}" for d in range(4)) + " FROM {s} GROUP BY hour(ts)",
    "daily_mean": f"SELECT CAST(ts AS DATE) AS day, {MEAN} AS mean_ntu, CAST(count(ntu) AS BIGINT) AS n FROM {{s}} GROUP BY CAST(ts AS DATE)",
    "argmin_grid": f"WITH g AS (SELECT hour(ts) AS h, dayofyear(ts) % 2 AS odd, {MEAN} AS score FROM {{s}} GROUP BY hour(ts), dayofyear(ts) % 2) SELECT h, odd, score FROM g ORDER BY score, h, odd LIMIT 1",
    "topk_factors": f"SELECT hour(ts) AS factor, {MEAN} AS importance, CAST(row_number() OVER (ORDER BY {MEAN} DESC, hour(ts)) AS BIGINT) AS importance_rank FROM {{s}} GROUP BY hour(ts) ORDER BY importance DESC, factor LIMIT 8",
    "union_tagged": "SELECT 'day' AS model, CAST(op_day AS STRING) AS key, round(max(ntu), 6) AS value FROM {s} GROUP BY op_day UNION ALL SELECT 'hour' AS model, CAST(hour(ts) AS STRING) AS key, round(max(ntu), 6) AS value FROM {s} GROUP BY hour(ts)",
    "ridge_1d": "WITH v AS (SELECT rw AS x, ntu AS y FROM {s} WHERE rw IS NOT NULL AND ntu IS NOT NULL AND t_idx < 240), m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, CAST(count(*) AS DOUBLE) AS n, covar_pop(x, y) AS sxy FROM v) SELECT l AS ridge, round(n * sxy / sx / (n + l), 6) AS coefficient, round(my, 6) AS intercept FROM m CROSS JOIN (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(1 AS DOUBLE)), (CAST(10 AS DOUBLE)), (CAST(100 AS DOUBLE))) AS g(l)",
    "ridge_gram": f"WITH f AS (SELECT {_lags(('rw', 'alum', 'ph'), (0, 1))}, ntu AS y FROM {{s}}) SELECT CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(CAST(sum(CAST(CAST(round({a} * 1000000) AS BIGINT) * CAST(round({b} * 1000000) AS BIGINT) AS DECIMAL(38, 0))) AS DOUBLE) / 1e12, 3) AS g_{a}_{b}" for a, b in (("rw_lag0", "rw_lag0"), ("rw_lag0", "rw_lag1"), ("rw_lag0", "alum_lag0"), ("rw_lag1", "ph_lag1"), ("alum_lag1", "y"), ("ph_lag0", "y"))) + " FROM f WHERE rw_lag0 IS NOT NULL AND rw_lag1 IS NOT NULL AND alum_lag0 IS NOT NULL AND alum_lag1 IS NOT NULL AND ph_lag0 IS NOT NULL AND ph_lag1 IS NOT NULL AND y IS NOT NULL",
    "observed_or_predicted": f"SELECT op_day, round(max(coalesce(filt, p)), 6) AS value, CASE WHEN avg(CASE WHEN filt IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) = 0 THEN 'observed' WHEN avg(CASE WHEN filt IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) = 1 THEN 'predicted' ELSE 'mixed' END AS source FROM (SELECT op_day, filt, lag(ntu) {W} AS p FROM {{s}}) x GROUP BY op_day",
    "odd_hour_interp": f"SELECT t_idx, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(exp((ln(1 + a) + ln(1 + b)) / 2) - 1, 5) END AS odd_hour FROM (SELECT t_idx, ntu AS a, lead(ntu) {W} AS b FROM {{s}}) x",
    "scenario_elasticity": f"SELECT t_idx, factor, round(0.4 * rw * (factor - 1), 6) AS delta, CASE WHEN base > 0 AND factor <> 1 THEN round(0.4 * rw * (factor - 1) / base / (factor - 1), 6) END AS elasticity FROM (SELECT t_idx, rw, 5 + 0.4 * rw + 0.2 * alum AS base FROM {{s}} WHERE rw IS NOT NULL AND alum IS NOT NULL) x CROSS JOIN (VALUES (CAST(0.9 AS DOUBLE)), (CAST(1.1 AS DOUBLE))) AS g(factor)",
    "histogram_40": "WITH p AS (SELECT min(ntu) AS lo, percentile_cont(0.99) WITHIN GROUP (ORDER BY ntu) AS hi FROM {s}), v AS (SELECT CAST(least(floor(round((ntu - lo) / (hi - lo) * 40, 6)), 39) AS BIGINT) AS bin FROM {s} CROSS JOIN p WHERE ntu <= hi) SELECT bin, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY bin",
}
