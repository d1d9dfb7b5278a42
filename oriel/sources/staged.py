"""Staged readings: folders of text files with a header, their gates, and where each file came from.

A staged file has the column row_no beside the cells of a sheet, as files have no order in
Spark. The month is part of the file's name (month-2025-07.csv); a sheet of one day is a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.ordered import in_order
from oriel.session import release

#: Start of each of an operating day's twelve readings; hours before 7 belong to the next calendar day.
SLOTS = tuple(f"{(7 + 2 * k) % 24:02d}00" for k in range(12))


def normalised(name: str) -> str:
    """A header cell as a column name: capital letters, no spaces around or doubled."""
    return " ".join(name.split()).upper()


def scan_folder(spark: SparkSession, folder: str, files: int | None = None, pattern: str = "*.csv", source: str = "[^/]+$") -> DataFrame:
    """All matching files under the folder as text columns, with source (the file's name, or what the expression finds in its path); raises if there are not `files` of them.

    Headers are normalised; columns without a name are dropped. Every file must have the first one's header.
    """
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("enforceSchema", False).csv(folder)
    found = raw.withColumn("source", F.regexp_extract(F.input_file_name(), source, 0))
    if files is not None and (n := found.select("source").distinct().count()) != files:
        raise ValueError(f"{n} files under {folder}, {files} expected")
    kept = [c for c in raw.columns if not c.startswith("_c") and c.strip()]
    return found.select("source", *[F.col(f"`{c}`").alias(normalised(c)) for c in kept])


def schema_gate(df: DataFrame, required: set[str], optional: set[str] = frozenset()) -> DataFrame:
    """df, if it has all required columns and none that is unknown; else ValueError names them."""
    own = set(df.columns)
    if missing := required - own:
        raise ValueError(f"missing columns: {sorted(missing)}")
    if unknown := own - required - optional:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    return df


def drop_blank(df: DataFrame, column: str = "TIME") -> DataFrame:
    """Rows in which the cell is neither null nor blank."""
    return df.where(F.trim(column) != "")


def row_count_gate(df: DataFrame, expected: Column, by: str = "source") -> DataFrame:
    """df; reading it fails where a group has another number of rows than `expected`, an expression over its columns."""
    n = F.count("*").over(Window.partitionBy(by))
    text = F.concat(F.col(by), F.lit(": "), n.cast("string"), F.lit(" rows, "), expected.cast("string"), F.lit(" expected"))
    return df.withColumn("_n", F.when(n == expected, n).otherwise(F.raise_error(text).cast("long"))).where("_n is not null").drop("_n")


def month_of(source: Column) -> Column:
    """First day of the month in a file's name, null without one."""
    return F.try_to_date(F.concat(F.regexp_extract(source, r"(\d{4}-\d{2})", 1), F.lit("-01")), "yyyy-MM-dd")


def normal_time(cell: Column) -> Column:
    """A time cell such as 700.0 as four digits, null for what is no number."""
    return F.lpad(F.trim(cell).try_cast("double").cast("int").cast("string"), 4, "0")


def with_clock(df: DataFrame, month: Column, row_no: Column, cell: Column) -> DataFrame:
    """df with op_day, slot, ts and time_repaired from the position of each row, from 0 in its month; the cell only tells whether it was repaired."""
    day, place = F.date_add(month, F.floor(row_no / 12).cast("int")), (row_no % 12).cast("int")
    slot = F.element_at(F.array(*[F.lit(s) for s in SLOTS]), place + 1)
    hour = F.substring(slot, 1, 2).cast("int")
    ts = F.expr("cast(op_day as timestamp_ntz) + make_dt_interval(if(_hour < 7, 1, 0), _hour, 0, 0)")
    rows = df.withColumns({"op_day": day, "slot": slot, "_hour": hour})
    return rows.withColumn("ts", ts).withColumn("time_repaired", ~normal_time(cell).eqNullSafe(F.col("slot"))).drop("_hour")


def checked_time(df: DataFrame, column: str) -> DataFrame:
    """df with the column as four digits; reading it fails for a cell that is no number."""
    made = normal_time(F.col(column))
    return df.withColumn(column, F.when(made.isNotNull(), made).otherwise(F.raise_error(F.concat(F.lit("bad time: "), F.coalesce(column, F.lit("null")))).cast("string")))


def timeline_gate(df: DataFrame, rows: int, time: str = "ts", step_hours: int = 2) -> DataFrame:
    """df, if it has that many rows with as many different times, all one step apart; else ValueError tells the first gap.

    Times are sorted into ranges, so that no task sees them all.
    """
    ordered = in_order(df.select(F.col(time).alias("at")), "at", previous=("at",))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    step = (seconds("at") - seconds("previous_at")) / 3600
    new = F.col("at").isNotNull() & (F.col("previous_at").isNull() | (step != 0))
    found = ordered.agg(F.count("*").alias("n"), F.count_if(new).alias("distinct"), F.min(F.when(step != step_hours, F.col("at"))).alias("bad")).first()
    release(ordered)
    if found["n"] != rows or found["distinct"] != rows or found["bad"] is not None:
        raise ValueError(f"{found['n']} rows, {found['distinct']} times, {rows} expected; first wrong step at {found['bad']}")
    return df


def expect(df: DataFrame, **counts: tuple[Column, int]) -> DataFrame:
    """df, if each named condition holds in exactly that many rows; else ValueError tells all that don't."""
    found = df.agg(*[F.count_if(c).alias(k) for k, (c, _) in counts.items()]).first()
    if wrong := {k: (found[k], n) for k, (_, n) in counts.items() if found[k] != n}:
        raise ValueError(f"unexpected counts (found, expected): {wrong}")
    return df


def provenance(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Rows (path, bytes, sha256): a digest of every file under the folder, read once, each in a task of its own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def semantic_digest(df: DataFrame, order: str, by: str = "source", bits: int = 16) -> DataFrame:
    """Rows (by, records, digest): of each group's rows in order, as JSON with trimmed texts; other columns keep their order. A group is one file.

    order is a whole number, as row_no. Digests form a tree of three levels: rows whose numbers
    agree but for the last `bits` bits are one node, nodes likewise, and a group has one digest of
    the nodes above. So a task holds some 2^bits digests at a time, and the result doesn't depend
    on partitions. Rows with equal numbers go by their digests.
    """
    own = [c for c in df.columns if c not in (by, order)]
    texts = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    row = F.to_json(F.struct(*[(F.trim(c) if c in texts else F.col(f"`{c}`")).alias(c) for c in own]), {"ignoreNullFields": "false"})
    nodes = df.select(F.col(by).alias("group"), F.col(order).cast("long").alias("place"), F.sha2(row, 256).alias("node"), F.lit(1).cast("long").alias("records"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]), "\n"), 256)
    for level in range(3):
        above = [F.shiftright("place", bits).alias("place")] if level < 2 else []
        nodes = nodes.groupBy("group", *above).agg(F.sum("records").alias("records"), joined.alias("node"))
    return nodes.select(F.col("group").alias(by), "records", F.col("node").alias("digest"))
