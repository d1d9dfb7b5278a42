"""Gaps filled by a recursion on the two values before."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _walk(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("t_idx")
    one, two, out = frame["one"].iloc[0], frame["two"].iloc[0], []
    for y, x in zip(frame["y"], frame["x"], strict=True):
        if pd.isna(y) and not pd.isna(one):
            y = 0.6 * one + 0.3 * (one if pd.isna(two) else two) + 0.1 * (one if pd.isna(x) else x)
        one, two = y, one
        out.append(y)
    return frame[["series_id", "t_idx"]].assign(filled=out)


def fill_gaps(slots: DataFrame, y: str, x: str) -> DataFrame:
    """Rows (series_id, t_idx, filled): y, or where it is null 0.6, 0.3 and 0.1 of the last two filled values and x.

    A missing second value or x counts as the last value; what stands before the first value
    stays null. The recursion starts anew where the two rows before are observed, so a series
    falls into short stretches that run side by side: no task holds a series, only a stretch.
    """
    by = Window.partitionBy("series_id").orderBy("t_idx")
    rows = slots.select("series_id", "t_idx", F.col(y).alias("y"), F.col(x).alias("x")).withColumn("one", F.lag("y", 1).over(by)).withColumn("two", F.lag("y", 2).over(by))
    fresh = (F.col("one").isNotNull() & F.col("two").isNotNull()).cast("long")
    stretches = rows.withColumn("stretch", F.sum(fresh).over(by))
    return stretches.groupBy("series_id", "stretch").applyInPandas(_walk, "series_id string, t_idx long, filled double")


#: The rows of the query gap_recursion for DuckDB, after the slots.
GAPS_SQL = """, r AS (SELECT t_idx, filt AS y1, CAST(NULL AS DOUBLE) AS y2 FROM slots WHERE t_idx = 0
  UNION ALL SELECT s.t_idx, coalesce(s.filt, 0.6 * r.y1 + 0.3 * coalesce(r.y2, r.y1) + 0.1 * coalesce(s.rw, r.y1)), r.y1 FROM r JOIN slots s ON s.t_idx = r.t_idx + 1)
SELECT t_idx, round(y1, 6) AS filled FROM r"""
