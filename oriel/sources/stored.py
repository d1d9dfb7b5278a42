"""Slots stored by operating day and read by range: days outside it are never opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.session import fresh_folder


def store_by_day(slots: DataFrame, path: str | None = None, day: str = "op_day") -> str:
    """Writes slots into one folder a day, in order of series and slot, and returns where; without a path, into the shared folder."""
    path = path or fresh_folder(slots.sparkSession, "days")
    # A day's rows go to one task; slots of a day are few, however many events made them.
    slots.repartition(day).sortWithinPartitions("series_id", "t_idx").write.partitionBy(day).option("compression", "zstd").parquet(path)
    return path


def read_days(spark: SparkSession, path: str, first: str, last: str, day: str = "op_day") -> DataFrame:
    """The rows of the days from first to last, both included."""
    return spark.read.parquet(path).where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def in_month(day: Column, month: str) -> Column:
    """Whether a day lies in a month, written as the prefix that its text starts with."""
    first = F.to_date(F.lit(f"{month}-01"))
    return (day >= first) & (day < F.add_months(first, 1))
