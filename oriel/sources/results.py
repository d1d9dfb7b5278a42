"""Result tables: written as Parquet or text, read back, validated and listed in a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.sources.staged import provenance

# What spreadsheets write into cells that have no result.
ERROR_CELLS = ("#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A", "#NUM!", "#NULL!")


def ten_digits(x: Column) -> Column:
    """A number as text with ten significant digits, without zeros at the end; null for null and for what isn't finite."""
    size = F.floor(F.log10(F.abs(x)))
    fixed = F.replace(F.call_function("format_number", x, F.greatest(F.lit(0), 9 - size).cast("int")), F.lit(","), F.lit(""))
    text = F.when(x == 0, F.lit("0")).when((size >= 10) | (size < -4), F.format_string("%.9e", x)).otherwise(fixed)
    trimmed = F.when(text.contains("e"), F.regexp_replace(text, r"\.?0*e", "e")).when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), trimmed)


def write_text(df: DataFrame, path: str, mark: bool = False, files: int | None = None) -> None:
    """Writes df as text with a header, numbers with ten digits; mark: a byte order mark before each header; files: how many (as many as partitions).

    For result tables; large ones are better written as Parquet.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = df.select(*[ten_digits(F.col(f"`{c}`")).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])
    if mark:
        out = out.withColumnRenamed(df.columns[0], "﻿" + df.columns[0])
    (out if files is None else out.coalesce(files)).write.option("header", True).option("quoteAll", False).option("emptyValue", "").csv(path)


def read_text(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Reads what write_text() wrote, with types as in the schema, or found from the cells; a byte order mark doesn't matter."""
    raw = spark.read.option("header", True).option("inferSchema", schema is None).csv(path)
    named = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if schema is None:
        return named
    return named.selectExpr(*[f"cast(`{c.split()[0]}` as {c.split(None, 1)[1]}) as `{c.split()[0]}`" for c in schema.split(", ")])


def finite(df: DataFrame) -> DataFrame:
    """df with null for every number that is none or infinite, as JSON has none of these."""
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in floats})


def as_json(df: DataFrame) -> DataFrame:
    """One column value: each row as JSON, nulls kept, dates in ISO form."""
    return finite(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, value: JSON with each table's rows as a list under its name. For tables whose rows are bounded (metrics, parameters)."""
    out = None
    for name, df in tables.items():
        one = finite(df).agg(F.array_sort(F.collect_list(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))).alias("rows")).select(F.concat(F.lit(f'"{name}":['), F.array_join("rows", ","), F.lit("]")).alias("part"), F.lit(name).alias("name"))
        out = one if out is None else out.union(one)
    return out.agg(F.array_sort(F.collect_list(F.struct("name", "part"))).alias("all")).select(F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["part"]), ","), F.lit("}")).alias("value"))


def write_paths(paths: DataFrame, path: str, groups: int = 16) -> None:
    """Writes simulated paths as Parquet, dealt by path, so that a reader of some paths reads few files."""
    paths.withColumn("path_group", F.pmod(F.xxhash64("path"), F.lit(groups))).repartition(groups, "path_group").sortWithinPartitions("path").write.partitionBy("path_group").parquet(path)


def validate(tables: dict[str, DataFrame], required: set[str]) -> DataFrame:
    """Rows (table, rows, error_cells, formulas): raises ValueError for a required table that lacks or is empty, or a cell with a spreadsheet's error."""
    if missing := required - set(tables):
        raise ValueError(f"missing tables: {sorted(missing)}")
    out = None
    for name, df in tables.items():
        texts = [f"`{f.name}`" for f in df.schema.fields if f.dataType.simpleString() == "string"]
        cells = F.array(*[F.col(c) for c in texts]) if texts else F.array().cast("array<string>")
        errors = F.size(F.filter(cells, lambda x: F.trim(x).isin(*ERROR_CELLS)))
        formulas = F.size(F.filter(cells, lambda x: F.startswith(x, F.lit("="))))
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(errors), F.lit(0)).alias("error_cells"), F.coalesce(F.sum(formulas), F.lit(0)).alias("formulas")).select(F.lit(name).alias("table"), "*")
        out = one if out is None else out.unionByName(one)
    found = out.collect()  # one row a table
    if wrong := [r["table"] for r in found if (r["table"] in required and not r["rows"]) or r["error_cells"]]:
        raise ValueError(f"empty tables or error cells in {sorted(wrong)}")
    return tables[next(iter(tables))].sparkSession.createDataFrame(found, out.schema)


def manifest(spark: SparkSession, folders: dict[str, str], parameters: dict[str, str]) -> DataFrame:
    """Rows (role, name, bytes, sha256): every file of the folders by role, and each parameter as a row without bytes."""
    out = spark.createDataFrame([("parameter", f"{k}={v}", None, None) for k, v in sorted(parameters.items())], "role string, name string, bytes long, sha256 string")
    for role, folder in folders.items():
        out = out.union(provenance(spark, folder).select(F.lit(role), "path", "bytes", "sha256"))
    return out
