"""Regular two-hour slots from an event log, with the operating day that starts at 07:00."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Series of an event: all events are one, or users fall into four.
ONE, FOUR = "'all'", "cast(user_id % 4 as string)"
#: Measured series: name and the event type whose values it averages (None: all).
SERIES = (("ntu", None), ("filt", "error"), ("rw", "view"), ("ph", "click"), ("alum", "purchase"), ("flow", "signup"))


def slot_means(events: DataFrame, series: str = ONE) -> DataFrame:
    """One row a series and non-empty slot: means by type, count, and the mean of props.k. One shuffle, combined map-side."""
    start = F.window("ts", "2 hours", "2 hours", "1 hour")["start"].alias("ts")
    means = [F.round(F.avg("value" if kind is None else F.when(F.col("event_type") == kind, F.col("value"))), 6).alias(name) for name, kind in SERIES]
    keyed = events.select(F.expr(series).alias("series_id"), start, "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return keyed.groupBy("series_id", "ts").agg(*means, F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("k"))


def regular_slots(events: DataFrame, series: str = ONE) -> DataFrame:
    """slot_means() on a gap-free calendar of each series, with t_idx and op_day; empty slots have nulls and n 0."""
    means = slot_means(events, series)
    span = means.groupBy("series_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    calendar = span.select("series_id", F.posexplode(F.expr("sequence(first, last, interval 2 hours)")).alias("t_idx", "ts"))
    filled = calendar.join(means, ["series_id", "ts"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.withColumn("op_day", F.expr("cast(ts - interval '7' hour as date)")).withColumn("t_idx", F.col("t_idx").cast("long"))


#: The same table for DuckDB, as a common table expression.
SLOTS_SQL = """
means AS (SELECT 'all' AS series_id, time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '2000-01-01 01:00:00') AS ts,
  round(avg(value), 6) AS ntu, round(avg(value) FILTER (WHERE event_type = 'error'), 6) AS filt, round(avg(value) FILTER (WHERE event_type = 'view'), 6) AS rw,
  round(avg(value) FILTER (WHERE event_type = 'click'), 6) AS ph, round(avg(value) FILTER (WHERE event_type = 'purchase'), 6) AS alum,
  round(avg(value) FILTER (WHERE event_type = 'signup'), 6) AS flow, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS k
  FROM events GROUP BY 1, 2),
slots AS (SELECT c.series_id, c.ts, (epoch(c.ts) - epoch(c.first)) / 7200 AS t_f, CAST((epoch(c.ts) - epoch(c.first)) / 7200 AS BIGINT) AS t_idx, ntu, filt, rw, ph, alum, flow, coalesce(n, 0) AS n, k,
  CAST(c.ts - INTERVAL '7' HOUR AS DATE) AS op_day
  FROM (SELECT series_id, min(ts) AS first, unnest(generate_series(min(ts), max(ts), INTERVAL '2 hours')) AS ts FROM means GROUP BY series_id) c
  LEFT JOIN means m ON m.series_id = c.series_id AND m.ts = c.ts)
"""
#: The same with FOUR series.
FOUR_SLOTS_SQL = SLOTS_SQL.replace("'all' AS series_id", "CAST(user_id % 4 AS VARCHAR) AS series_id")
