"""Daily risk: how far and how long a series stays over a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LIMIT, STEP_HOURS = 55.0, 2
#: Grades in order of severity; a day with fewer valid slots than LEAST_VALID has none.
GRADES, NO_GRADE, LEAST_VALID = ("SAFE", "LOW", "MEDIUM", "HIGH"), "INSUFFICIENT", 9
#: Largest amplitude and longest run in hours of the grades LOW and MEDIUM.
LOW, MEDIUM = (10.0, 4), (20.0, 8)


def longest_run(above: Column) -> Column:
    """Most true values in a row in an array."""
    step = lambda s, x: F.struct(F.when(x, s["run"] + 1).otherwise(0).alias("run"), F.greatest(s["best"], F.when(x, s["run"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(above, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda s: s["best"])


def daily_risk(slots: DataFrame, value: str = "ntu", limit: float = LIMIT) -> DataFrame:
    """Rows (series_id, op_day, valid_points, max_value, amplitude, longest_hours, exceedance_load) of days with a value.

    A run goes on over missing slots. One shuffle; a day's values, of twelve slots at most, are one array.
    """
    known = slots.where(F.col(value).isNotNull()).groupBy("series_id", "op_day").agg(F.array_sort(F.collect_list(F.struct("t_idx", F.col(value).alias("v")))).alias("day"))
    values = known.select("series_id", "op_day", F.transform("day", lambda x: x["v"]).alias("day"))
    over = F.transform("day", lambda v: F.greatest(v - limit, F.lit(0.0)))
    return values.select(
        "series_id",
        "op_day",
        F.size("day").cast("long").alias("valid_points"),
        F.array_max("day").alias("max_value"),
        F.array_max(over).alias("amplitude"),
        (longest_run(F.transform("day", lambda v: v > limit)) * STEP_HOURS).cast("long").alias("longest_hours"),
        (F.aggregate(over, F.lit(0.0), lambda s, x: s + x) * STEP_HOURS).alias("exceedance_load"),
    )


def grade(low: tuple = LOW, medium: tuple = MEDIUM) -> Column:
    """The grade of a row of daily_risk(); both bounds of a grade must hold."""
    within = lambda bounds: (F.col("amplitude") <= bounds[0]) & (F.col("longest_hours") <= bounds[1])
    safe, light, middle, high = GRADES
    graded = F.when(F.col("amplitude") <= 0, safe).when(within(low), light).when(within(medium), middle).otherwise(high)
    return F.when(F.col("valid_points") < LEAST_VALID, NO_GRADE).otherwise(graded)


def unchanged_share(days: DataFrame, lows: tuple, mediums: tuple, briefs: tuple, lastings: tuple) -> DataFrame:
    """Rows (series_id, low, medium, brief, lasting, unchanged): the share of days whose grade is the same by other bounds.

    Each day is set against all sets of bounds, and shares are added up before the shuffle.
    """
    grid = days.withColumn("_own", grade())
    for name, values in (("low", lows), ("medium", mediums), ("brief", briefs), ("lasting", lastings)):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    same = grade((F.col("low"), F.col("brief")), (F.col("medium"), F.col("lasting"))) == F.col("_own")
    return grid.groupBy("series_id", "low", "medium", "brief", "lasting").agg(F.avg(same.cast("double")).alias("unchanged"))


def interpolated(slots: DataFrame, value: str, most: int = 3) -> DataFrame:
    """Rows (series_id, t_idx, filled): straight lines over gaps, held after their first `most` slots; ends take the nearest value."""
    by = Window.partitionBy("series_id").orderBy("t_idx")
    known = F.when(F.col(value).isNotNull(), F.struct("t_idx", F.col(value).alias("v")))
    p = F.last(known, True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    q = F.first(known, True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = slots.select("series_id", "t_idx", p.alias("p"), q.alias("q"))
    steps = F.least(F.col("t_idx") - F.col("p.t_idx"), F.lit(most))
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * steps / (F.col("q.t_idx") - F.col("p.t_idx"))
    return rows.select("series_id", "t_idx", F.when(F.col("p").isNull(), F.col("q.v")).when(F.col("q").isNull() | (F.col("p.t_idx") == F.col("q.t_idx")), F.col("p.v")).otherwise(line).alias("filled"))
