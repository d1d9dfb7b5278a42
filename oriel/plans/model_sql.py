"""Raw cells, digests and simulated paths, as SQL that Spark and DuckDB read alike.

{s} stands for the slots, {e} for the events, {taps} for the numbers from 0 to 39. Draws come
from an integer congruence of the draw's number, so both engines draw alike whatever the partitions.
"""

from oriel.plans.series_sql import W, _metrics

CELL = "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN ' - ' WHEN event_id % 17 = 0 THEN '12..5' WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN 'NaN' ELSE ' ' || CAST(value AS STRING) || ' ' END"


def _draw(rep: str, place: str, size: str) -> str:
    return f"((CAST({rep} AS BIGINT) * 48271 + CAST({place} AS BIGINT) * 69621 + 12345) * 16807 % 2147483647) % {size}"


def _numbers(name: str, count: int) -> str:
    """A common table expression of the numbers from 0 to count - 1, 1600 at most."""
    return f"{name} AS (SELECT a.k * 40 + b.k AS {name} FROM (SELECT k FROM {{taps}}) a CROSS JOIN (SELECT k FROM {{taps}}) b WHERE a.k * 40 + b.k < {count})"


#: 500 paths of a first-order residual (0.8) over 24 slots; errors in circular blocks of 12.
PATHS = f"""WITH d AS (SELECT series_id, t_idx, ntu, ntu - lag(ntu) {W} AS e FROM {{s}}),
pool AS (SELECT e - avg(e) OVER (PARTITION BY series_id) AS e, row_number() {W} - 1 AS i FROM d WHERE e IS NOT NULL),
n AS (SELECT count(*) AS size FROM pool), o AS (SELECT max_by(ntu, t_idx) AS origin FROM d WHERE ntu IS NOT NULL), {_numbers('path', 500)}, {_numbers('h', 24)},
drawn AS (SELECT path, h AS j, ({_draw('path', 'floor(h / 12)', 'size')} + h % 12) % size AS i FROM path CROSS JOIN h CROSS JOIN n),
errors AS (SELECT path, j, e FROM drawn JOIN pool ON pool.i = drawn.i),
y AS (SELECT path, h, sum(power(CAST(0.8 AS DOUBLE), h - j) * e) AS r FROM errors JOIN h ON j <= h GROUP BY path, h)"""
FAN = PATHS + """ SELECT h + 1 AS horizon, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY origin + r), 5) AS low, round(median(origin + r), 5) AS mid, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY origin + r), 5) AS high FROM y CROSS JOIN o GROUP BY h"""
VOTES = PATHS + """, g AS (SELECT path, CASE WHEN max(origin + r) <= 55 THEN 'SAFE' WHEN max(origin + r) <= 65 THEN 'LOW' WHEN max(origin + r) <= 75 THEN 'MEDIUM' ELSE 'HIGH' END AS grade FROM y CROSS JOIN o GROUP BY path)
SELECT k.grade, round(count(g.grade) / CAST(500 AS DOUBLE), 6) AS probability FROM (VALUES ('SAFE'), ('LOW'), ('MEDIUM'), ('HIGH')) AS k(grade) LEFT JOIN g ON g.grade = k.grade GROUP BY k.grade"""

MODEL_SQL: dict[str, str] = {
    "parse_cells": f"SELECT event_id, CASE WHEN NOT isnan(x) THEN x END AS clean, coalesce(cell, '') NOT IN ('', '-') AND (x IS NULL OR isnan(x)) AS invalid FROM (SELECT event_id, cell, TRY_CAST(cell AS DOUBLE) AS x FROM (SELECT event_id, trim({CELL}) AS cell FROM {{e}}) a) b",
    "rebuilt_clock": "SELECT event_id, slot, op_day, CASE WHEN CAST(slot AS INT) < 700 THEN op_day + 1 ELSE op_day END AS calendar_day, raw <> slot AS repaired FROM (SELECT event_id, raw, lpad(CAST(CAST(TRY_CAST(raw AS DOUBLE) AS INT) AS STRING), 4, '0') AS slot, op_day FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CAST(hour(ts) * 100 AS STRING) || '.0' ELSE CAST(hour(ts) * 100 AS STRING) END AS raw, CAST(ts - INTERVAL '7' HOUR AS DATE) AS op_day FROM {e}) a) b",
    "semantic_digest": "SELECT op_day, {digest} AS digest FROM (SELECT op_day, t_idx, CAST(t_idx AS STRING) || ':' || coalesce(CAST(CAST(round(ntu * 100) AS BIGINT) AS STRING), 'null') AS part FROM {s}) a GROUP BY op_day",
    "generalisation_gate": f"WITH v AS (SELECT t_idx, rw AS x, ntu AS y, lag(ntu, 12) {W} AS p FROM {{s}}), m AS (SELECT avg(x) AS mx, avg(y) AS my, count(*) * covar_pop(x, y) / (var_pop(x) * (count(*) + 1)) AS slope FROM v WHERE x IS NOT NULL AND y IS NOT NULL AND t_idx < 240), a AS (SELECT {_metrics('y', 'z')} FROM (SELECT y, my + slope * (x - mx) AS z FROM v CROSS JOIN m WHERE t_idx >= 240) q WHERE y IS NOT NULL AND z IS NOT NULL), b AS (SELECT {_metrics('y', 'p')} FROM v WHERE t_idx >= 240 AND y IS NOT NULL AND p IS NOT NULL) SELECT a.rmse, a.r2, a.n, b.rmse AS baseline_rmse, b.n AS baseline_n, a.r2 >= 0 AND a.rmse < b.rmse AS passes FROM a CROSS JOIN b",
    "path_fan": FAN,
    "path_votes": VOTES,
}
