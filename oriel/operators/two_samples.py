"""Two samples: the largest distance of their distribution functions, and how likely one as large is by chance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

#: Product of both sizes up to which p is counted; beyond, Kolmogorov's series is as good.
MOST_CELLS = 4_000_000


def counted_p(apart: int, m: int, n: int) -> float:
    """The share of orders of m and n values without ties whose distance is `apart` / (m * n) or more.

    An order is a path from (0, 0) to (m, n). The share of paths to a place that have stayed
    within the distance follows from the two places before it; only places within it are visited.
    """
    if not m or not n:
        return 1.0
    inside = np.zeros(n + 1)
    for i in range(m + 1):
        low, high = max(0, (i * n - apart) // m + 1), min(n, -((-i * n - apart) // m) - 1)
        if low > high:
            return 1.0
        row = np.zeros(n + 1)
        for j in range(low, high + 1):
            row[j] = 1.0 if i + j == 0 else (i * inside[j] + (j * row[j - 1] if j else 0.0)) / (i + j)
        inside = row
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


def _counted(apart: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([counted_p(int(a), int(x), int(y)) for a, x, y in zip(apart, m, n, strict=True)])


def two_sample_distance(rows: DataFrame, keys: list[str], value: str, first: str) -> DataFrame:
    """Rows (keys, n_first, n_second, d_statistic, p, counted): of the values that the boolean `first` puts into one of two samples.

    Distances are compared as whole numbers. p is counted where the product of the sizes is
    MOST_CELLS at most (counted: true), else asymptotic; with ties it is an upper bound, as counts
    assume none. It is null where a sample is empty. Values are counted before they are put in order.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count_if(first).alias("a"), F.count_if(~F.col(first)).alias("b"))
    upto, whole = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys)
    sums = counts.select(*keys, *[F.sum(c).over(upto).alias(f"f{c}") for c in "ab"], *[F.sum(c).over(whole).alias(f"n{c}") for c in "ab"])
    found = sums.groupBy(*keys).agg(F.max("na").alias("n_first"), F.max("nb").alias("n_second"), F.max(F.abs(F.col("fa") * F.col("nb") - F.col("fb") * F.col("na"))).alias("apart"))
    cells = F.col("n_first") * F.col("n_second")
    d = F.when(cells > 0, F.col("apart") / cells)
    at = d * F.sqrt(cells / (F.col("n_first") + F.col("n_second")))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * at * at))
    told = found.withColumn("counted", cells <= MOST_CELLS)
    small = told.where("counted").withColumn("p", F.when(cells > 0, F.pandas_udf(_counted, DoubleType())("apart", "n_first", "n_second")))
    large = told.where("not counted").withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return small.unionByName(large).select(*keys, "n_first", "n_second", d.alias("d_statistic"), "p", "counted")
