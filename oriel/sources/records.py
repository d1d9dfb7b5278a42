"""Cells as text, parsed once a row: what was read, the number it is, and whether it is neither a number nor empty."""

from __future__ import annotations

from math import isnan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel.operators.passes import TOLD_APART, quantiles
from oriel.session import release, stage

#: Cells that hold nothing.
EMPTY = ("", "-")


def cell(raw: Column) -> tuple[Column, Column]:
    """(clean, invalid) of a cell: blank, dash and null are null and valid; what isn't a number (NaN isn't) is null and invalid."""
    text = F.trim(raw)
    number = text.try_cast("double")
    clean = F.when(~F.isnan(number), number)
    return clean, F.coalesce(~text.isin(*EMPTY) & clean.isNull(), F.lit(False))


def with_record(rows: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """rows with `record`, an array of structs (field, raw, clean, invalid), one for each of the cells, in their order."""
    made = []
    for name, raw in cells.items():
        clean, invalid = cell(raw)
        made.append(F.struct(F.lit(name).alias("field"), raw.alias("raw"), clean.alias("clean"), invalid.alias("invalid")))
    return rows.withColumn("record", F.array(*made))


def spread(rows: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """Columns keep, and of each field its clean value, and what was read and whether it is invalid under <field>_raw and <field>_invalid."""
    out = []
    for k, f in enumerate(fields):
        part = F.col("record")[k]
        out += [part["clean"].alias(f), part["raw"].alias(f"{f}_raw"), part["invalid"].alias(f"{f}_invalid")]
    return rows.select(*keep, *out)


def record_profile(rows: DataFrame, fields: list[str], most: int = TOLD_APART) -> DataFrame:
    """Rows (field, total, missing, missing_rate, invalid, minimum, median_value, maximum) of the fields of the records; none without rows.

    Medians are exact and found by counts of leading bits over the staged numbers: no task holds
    more than `most` distinct values of a field at a time.
    """
    record = F.col("record")
    numbers = stage(rows.select(*[record[k]["clean"].alias(f"x{k}") for k in range(len(fields))]), "numbers")
    each = lambda x: ((k, x[:, k]) for k in range(x.shape[1]))
    middles = quantiles(numbers, [F.col(c) for c in numbers.columns], each, (0.5,), most)
    release(numbers)
    known = [F.lit(v) for k, f in enumerate(fields) if k in middles and not isnan(middles[k][0]) for v in (f, round(float(middles[k][0]), 7))]
    middle = F.create_map(*known)[F.col("field")] if known else F.lit(None).cast("double")
    clean, rate = F.col("clean"), F.round(1 - F.count("clean") / F.count("*"), 6)
    counts = rows.select(F.inline("record")).groupBy("field").agg(F.count("*").alias("total"), (F.count("*") - F.count(clean)).alias("missing"), rate.alias("missing_rate"), F.count_if("invalid").alias("invalid"), F.min(clean).alias("minimum"), F.max(clean).alias("maximum"))
    return counts.select("field", "total", "missing", "missing_rate", "invalid", "minimum", middle.alias("median_value"), "maximum")
