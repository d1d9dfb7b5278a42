"""Queries over what sources and sinks make of the event log: staged files and their gates, result files read back, digests, global order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.operators.calendar import SLOTS_SQL, regular_slots
from oriel.operators.ordered import in_order
from oriel.session import fresh_folder
from oriel.sources import read_table, results, staged

DIGEST_BITS = 8
MONTH = "2024-01"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_slots(read_table(spark, sf_dir, "events"))


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir).groupBy("series_id", "op_day").agg(F.count("ntu").alias("n"), F.round(F.min("ntu"), 4).alias("least"), F.round(F.max("filt"), 4).alias("most"))


def events_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered by time over the whole log, with the event before and the seconds since."""
    rows = in_order(read_table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", previous=("event_id", "ts"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))
    return rows.select("row_no", "event_id", "previous_event_id", F.floor(seconds / 1000000).alias("seconds"))


def event_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest a type of its events in order, as a tree of nodes of 256 numbers."""
    cents = F.round(F.col("value") * 100).cast("long").alias("cents")
    rows = read_table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", cents)
    return staged.semantic_digest(rows, "event_id", "event_type", DIGEST_BITS)


def staged_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month of slots written as a staged file with a careless header and time cells, read through all gates, with its clock rebuilt."""
    slots = spark.range(31 * 12).select(F.col("id").cast("int").alias("row_no"), F.expr(f"timestamp '{MONTH}-01 07:00:00' + make_dt_interval(0, 2 * cast(id as int))").alias("ts"))
    own = _slots(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "ntu")
    hour = F.hour("ts") * 100
    cell = F.when(F.col("row_no") % 50 == 49, F.lit("5.87")).when(F.col("row_no") % 3 == 0, F.concat(F.lit(" "), hour.cast("string"), F.lit(".0"))).otherwise(hour.cast("string"))
    sheet = slots.join(own, "ts", "left").select("row_no", cell.alias(" time "), F.col("ntu").alias("Raw  ntu"), F.lit(MONTH).alias("month"))
    path = fresh_folder(spark, "staged")
    sheet.coalesce(1).write.partitionBy("month").option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    raw = staged.scan_folder(spark, path, 1, source="month=[^/]+")
    rows = staged.drop_blank(staged.schema_gate(raw, {"source", "ROW_NO", "TIME"}, {"RAW NTU"}))
    month = staged.month_of(F.col("source"))
    counted = staged.row_count_gate(rows, F.dayofmonth(F.last_day(month)) * 12)
    clocked = staged.with_clock(counted, month, F.col("ROW_NO").cast("int"), F.col("TIME"))
    gated = staged.timeline_gate(clocked, 31 * 12)
    return gated.select(F.col("ROW_NO").cast("int").alias("row_no"), "slot", "op_day", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("clock"), "time_repaired", F.col("RAW NTU").cast("double").alias("ntu"))


def text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values written as text with ten digits and a byte order mark, and read back by a schema."""
    path = fresh_folder(spark, "text")
    results.write_text(_days(spark, sf_dir), path, mark=True)
    return results.read_text(spark, path, "series_id string, op_day date, n bigint, least double, most double")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values written as JSON records, and read back by a schema."""
    path = fresh_folder(spark, "json")
    results.as_json(_days(spark, sf_dir)).write.text(path)
    return spark.read.schema("series_id string, op_day date, n bigint, least double, most double").json(path)


def path_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots dealt to fifty paths, stored as simulated paths are, and read back."""
    path = fresh_folder(spark, "paths")
    results.write_paths(_slots(spark, sf_dir).select((F.col("t_idx") % 50).alias("path"), "t_idx", "ntu"), path)
    return spark.read.parquet(path).select("path", "t_idx", "ntu")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("=A"), "event_id")).otherwise(F.col("event_type"))
    return read_table(spark, sf_dir, "events").select("event_id", text.alias("cell"))


def result_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, error cells and formulas of two result tables that must be there."""
    return results.validate({"days": _days(spark, sf_dir), "cells": _cells(spark, sf_dir)}, {"days", "cells"})


def result_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of a result file as the manifest lists it, and the run's parameters."""
    path = fresh_folder(spark, "result")
    # One file of one small number a slot: slots of a log are few, however many its events.
    results.write_text(_slots(spark, sf_dir).orderBy("series_id", "t_idx").select("series_id", "t_idx", "n"), path, files=1)
    listed = results.manifest(spark, {"output": path}, {"seed": "42", "horizons": "6"})
    return listed.select("role", F.when(F.col("role") == "parameter", F.col("name")).alias("name"), "bytes", "sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (events_in_order, event_digests, staged_month, text_round_trip, json_round_trip, path_round_trip, result_validation, result_manifest)}

_DAYS = f"WITH {SLOTS_SQL}, days AS (SELECT series_id, op_day, count(ntu) AS n, round(min(ntu), 4) AS least, round(max(filt), 4) AS most FROM slots GROUP BY series_id, op_day)"
_NODE = "sha256(string_agg(node, chr(10) ORDER BY place, node)) AS node, CAST(sum(records) AS BIGINT) AS records"
ORACLES = {
    "events_in_order": "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS row_no, event_id, lag(event_id) OVER (ORDER BY ts, event_id) AS previous_event_id, CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1000000) AS BIGINT) AS seconds FROM events",
    "event_digests": f"""WITH a AS (SELECT event_type, event_id AS place, 1 AS records, sha256('{{"user_id":' || coalesce(CAST(user_id AS VARCHAR), 'null') || ',"cents":' || coalesce(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), 'null') || '}}') AS node FROM events),
b AS (SELECT event_type, place >> {DIGEST_BITS} AS up, {_NODE} FROM a GROUP BY event_type, up),
c AS (SELECT event_type, place >> {DIGEST_BITS} AS up, {_NODE} FROM (SELECT event_type, up AS place, node, records FROM b) x GROUP BY event_type, up)
SELECT event_type, records, node AS digest FROM (SELECT event_type, {_NODE} FROM (SELECT event_type, up AS place, node, records FROM c) x GROUP BY event_type) y""",
    "staged_month": f"""WITH {SLOTS_SQL}, c AS (SELECT CAST(k AS INTEGER) AS row_no, TIMESTAMP '{MONTH}-01 07:00:00' + to_hours(CAST(2 * k AS INTEGER)) AS moment FROM range(372) AS t(k))
SELECT row_no, strftime(moment, '%H00') AS slot, CAST(moment - INTERVAL '7' HOUR AS DATE) AS op_day, strftime(moment, '%Y-%m-%d %H:%M') AS clock, row_no % 50 = 49 AS time_repaired, ntu FROM c LEFT JOIN slots ON slots.ts = c.moment""",
    "text_round_trip": f"{_DAYS} SELECT * FROM days",
    "json_round_trip": f"{_DAYS} SELECT * FROM days",
    "path_round_trip": f"WITH {SLOTS_SQL} SELECT t_idx % 50 AS path, t_idx, ntu FROM slots",
    "result_validation": f"{_DAYS} SELECT 'days' AS \"table\", count(*) AS rows, CAST(0 AS BIGINT) AS error_cells, CAST(0 AS BIGINT) AS formulas FROM days UNION ALL SELECT 'cells', count(*), CAST(0 AS BIGINT), count(*) FILTER (WHERE event_id % 7 = 0) FROM events",
    "result_manifest": f"WITH {SLOTS_SQL}, f AS (SELECT 'series_id,t_idx,n' || chr(10) || string_agg(series_id || ',' || t_idx || ',' || n || chr(10), '' ORDER BY series_id, t_idx) AS body FROM slots) SELECT 'output' AS role, NULL AS name, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS sha256 FROM f UNION ALL SELECT 'parameter', 'seed=42', NULL, NULL UNION ALL SELECT 'parameter', 'horizons=6', NULL, NULL",
}
