"""One order over all rows, without a task that sees them all.

Rows are sorted into ranges. Each range numbers its own rows; what crosses a border comes from
one row a range: how many rows lie before it, and the last of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.session import stage

#: monotonically_increasing_id() has a row's place in its partition in the lower 33 bits, the partition above.
PLACE_BITS = 33


def in_order(df: DataFrame, *order: str, previous: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """df with row_no, from 0 in the order of the given columns (nulls first), and previous_<c>, the values of the row before.

    The sorted rows are staged (release() deletes them); rows that are equal in `order` have one
    order, but another in each run. The columns _id and _range may not be df's own.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    staged = stage(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    rows = staged.withColumn("_range", F.shiftright("_id", PLACE_BITS))
    last = F.max_by(F.struct(F.lit(0), *previous), "_id").alias("_last")
    borders = Window.orderBy("_range")  # one row a range, of n at most
    upto = F.sum("_n").over(borders.rowsBetween(Window.unboundedPreceding, -1))
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_n"), last)
    starts = ranges.select("_range", F.coalesce(upto, F.lit(0)).alias("_start"), F.lag("_last", 1).over(borders).alias("_last"))
    place = F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    if previous:
        inside = Window.partitionBy("_range").orderBy("_id")
        rows = rows.withColumns({f"previous_{c}": F.lag(c, 1).over(inside) for c in previous})
    found = rows.join(F.broadcast(starts), "_range")
    before = [F.when(place == 0, F.col("_last")[c]).otherwise(F.col(f"previous_{c}")).alias(f"previous_{c}") for c in previous]
    out = found.select(*df.columns, (F.col("_start") + place).alias("row_no"), *before)
    out._staged_at = staged._staged_at
    return out
