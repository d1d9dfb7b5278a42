"""Queries on cells as text and on two samples; their SQL reads each field by a select of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.operators.calendar import SLOTS_SQL, regular_slots
from oriel.operators.two_samples import two_sample_distance
from oriel.sources import read_table
from oriel.sources.records import record_profile, spread, with_record
from oriel.sources.stored import in_month, read_days, store_by_day

FIELDS = ["value", "k", "user_id"]
TRAIN_BEFORE = 240
#: What a field's text is spoilt with, by the remainder of the event's number.
SPOILT = {11: "''", 13: "' - '", 17: "'48..9'", 19: "NULL", 23: "'NaN'"}


def _spoilt(text: str, shift: int) -> str:
    cases = " ".join(f"WHEN (event_id + {shift}) % {m} = 0 THEN {v}" for m, v in SPOILT.items())
    return f"CASE {cases} ELSE ' ' || CAST({text} AS STRING) || ' ' END"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return with_record(events, {f: F.expr(_spoilt(f, k)) for k, f in enumerate(FIELDS)})


def row_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event and field the text that was read, the number that it is, and whether it is invalid."""
    return spread(_records(spark, sf_dir), FIELDS, "event_id")


def invalid_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of all fields with missing and invalid cells, medians by counts."""
    return record_profile(_records(spark, sf_dir), FIELDS)


def ks_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of early and late values, and the counted chance of one as large."""
    rows = regular_slots(read_table(spark, sf_dir, "events")).withColumn("early", F.col("t_idx") < TRAIN_BEFORE)
    return two_sample_distance(rows, ["series_id"], "ntu", "early")


#: Days of the plotted range, and the series in it.
RANGE, PLOTTED = ("2024-01-10", "2024-01-19"), ("ntu", "filt", "rw", "ph")


def series_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four series over ten days, in order, from slots that are stored by day."""
    path = store_by_day(regular_slots(read_table(spark, sf_dir, "events")))
    return read_days(spark, path, *RANGE).select("series_id", "t_idx", "op_day", *PLOTTED).orderBy("series_id", "t_idx")


def month_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots by operating day of one month, as stored by day."""
    path = store_by_day(regular_slots(read_table(spark, sf_dir, "events")))
    return spark.read.parquet(path).where(in_month(F.col("op_day"), "2024-01")).groupBy("series_id", "op_day").agg(F.count("*").alias("slots"), F.round(F.max("ntu"), 6).alias("most"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (row_record, invalid_profile, ks_counted, series_by_range, month_slots)}

_EVENTS = "e AS (SELECT event_id, value, user_id, json_extract_string(props, '$.k') AS k FROM events)"
_NUMBER = "CASE WHEN regexp_full_match(trim(raw), '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN CAST(trim(raw) AS DOUBLE) END"
_LONG = " UNION ALL ".join(f"SELECT event_id, '{f}' AS field, {_spoilt(f, k)} AS raw FROM e" for k, f in enumerate(FIELDS))
_PARSED = f"WITH {_EVENTS}, long AS ({_LONG}), parsed AS (SELECT *, {_NUMBER} AS clean, raw IS NOT NULL AND trim(raw) NOT IN ('', '-') AND {_NUMBER} IS NULL AS invalid FROM long)"
_ONE = ", ".join(f"max(clean) FILTER (WHERE field = '{f}') AS {f}, max(raw) FILTER (WHERE field = '{f}') AS {f}_raw, bool_or(invalid) FILTER (WHERE field = '{f}') AS {f}_invalid" for f in FIELDS)
ORACLES = {
    "series_by_range": f"WITH {SLOTS_SQL} SELECT series_id, t_idx, op_day, {', '.join(PLOTTED)} FROM slots WHERE op_day >= DATE '{RANGE[0]}' AND op_day <= DATE '{RANGE[1]}'",
    "month_slots": f"WITH {SLOTS_SQL} SELECT series_id, op_day, count(*) AS slots, round(max(ntu), 6) AS most FROM slots WHERE starts_with(strftime(op_day, '%Y-%m-%d'), '2024-01') GROUP BY series_id, op_day",
    "row_record": f"{_PARSED} SELECT event_id, {_ONE} FROM parsed GROUP BY event_id",
    "invalid_profile": f"{_PARSED} SELECT field, count(*) AS total, count(*) - count(clean) AS missing, round(1 - count(clean) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, count(*) FILTER (WHERE invalid) AS invalid, min(clean) AS minimum, round(median(clean), 7) AS median_value, max(clean) AS maximum FROM parsed GROUP BY field",
}
