"""A fitted model of named features as Spark columns, its fit over all rows, and what its features matter to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.grids import Grid, Share, raw
from oriel.operators.local_fit import Fit
from oriel.session import release, stage


@dataclass
class Ridge:
    """A fitted model: bounds and median of the raw features, then weights of the standardised ones."""

    features: list[str]
    low: list[float]
    mid: list[float]
    high: list[float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    @staticmethod
    def of(features: list[str], fit: Fit) -> Ridge:
        return Ridge(features, fit.low.tolist(), fit.mid.tolist(), fit.high.tolist(), fit.mean, fit.scale, fit.weights, fit.intercept)

    def prepared(self, of: Callable[[str], Column] = F.col) -> list[Column]:
        """Features with nulls replaced by the median, cut at the bounds; of: where a feature is taken from."""
        return [F.least(F.greatest(F.coalesce(of(f).cast("double"), F.lit(m)), F.lit(a)), F.lit(b)) for f, a, m, b in zip(self.features, self.low, self.mid, self.high, strict=True)]

    def at(self, **values: float) -> float:
        """The prediction for one row on the driver; features that aren't named have their median."""
        x = np.array([values.get(f, m) for f, m in zip(self.features, self.mid, strict=True)])
        return float(self.intercept + (np.clip(x, self.low, self.high) - self.mean) / self.scale @ self.weights)

    def predict(self, of: Callable[[str], Column] = F.col) -> Column:
        total = F.lit(self.intercept)
        for x, m, s, w in zip(self.prepared(of), self.mean, self.scale, self.weights, strict=True):
            total = total + (x - F.lit(float(m))) * F.lit(float(w / s))
        return total


def fit_ridge(rows: DataFrame, features: list[str], target: str, ridge: float, robust: bool = False) -> Ridge:
    """Ridge on cut, filled and standardised features; robust: rounds of reweighting (HUBER_ROUNDS with the first fit).

    Bounds are the 0.5 and 99.5 percentiles of the known values, before filling; a feature
    without values counts as 0. Rows without a target are left out; no rows raise ValueError.
    The robust scale is 1.4826 times the median distance of residuals from their median, at
    least 1e-8; a residual is compared as it is, not from the median. What the passes read is
    staged once, so rows are computed once.
    """
    known = stage(rows.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in [*features, target]]), "fit")
    grid = Grid(known, F.lit(0), F.col(target), F.col(target), [F.col(f) for f in features])
    found = grid.fit([Share(1, raw)], (ridge,), robust)
    release(known)
    if not found:
        raise ValueError("no rows with a target")
    return Ridge.of(features, found[0, 0])


def permutation_importance(rows: DataFrame, model: Ridge, target: str, groups: dict[str, list[str]], block: int = 12, back: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """Rows (factor, importance): by how much the error grows when a factor's features come from another block.

    Whole blocks of t_idx change places by a hash of their number, all features of a factor
    together. One join serves all factors. A last block that isn't full is left out. back:
    leads from predictions to the scale of the target.
    """
    placed = rows.withColumn("_block", F.floor(F.col("t_idx") / block)).withColumn("_at", F.col("t_idx") % block)
    full = placed.groupBy("series_id", "_block").agg(F.count("*").alias("_n")).where(F.col("_n") == block).drop("_n")
    own, other = Window.partitionBy("series_id").orderBy("_block"), Window.partitionBy("series_id").orderBy(F.xxhash64("_block"), "_block")
    ranked = full.withColumn("_k", F.row_number().over(own)).withColumn("_j", F.row_number().over(other))
    swap = ranked.select("series_id", "_block", "_k").join(ranked.select("series_id", F.col("_j").alias("_k"), F.col("_block").alias("_from")), ["series_id", "_k"]).drop("_k")
    source = placed.select("series_id", F.col("_block").alias("_from"), "_at", *[F.col(f).alias(f"_{f}") for f in model.features])
    both = placed.join(swap, ["series_id", "_block"]).join(source, ["series_id", "_from", "_at"]).where(F.col(target).isNotNull())
    rmse = lambda p: F.sqrt(F.avg((F.col(target) - back(p)) * (F.col(target) - back(p))))
    moved = [F.struct(F.lit(name).alias("factor"), (rmse(model.predict(lambda f, own=own: F.col(f"_{f}" if f in own else f))) - rmse(model.predict())).alias("importance")) for name, own in groups.items()]
    return both.agg(F.array(*moved).alias("all")).select(F.inline("all"))
