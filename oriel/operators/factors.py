"""What a fitted factor model says of its factors: effects, directions, selection, parameters and partial curves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.grids import PLACES, Grid, Share, parts
from oriel.operators.local_fit import Fit
from oriel.operators.passes import quantiles as select_quantiles
from oriel.operators.regression import Ridge, permutation_importance

#: Share of folds that must agree on a direction, and ranks that can be selected.
AGREE, RANKS = 0.75, 6


def effect(model: Ridge, features: list[str], low: float, high: float) -> float:
    """Change of expm1 of the prediction when all features of a factor go from low to high, the others at their training medians."""
    return float(np.expm1(model.at(**dict.fromkeys(features, high))) - np.expm1(model.at(**dict.fromkeys(features, low))))


def quartiles(grid: Grid, shares: list[Share], columns: int) -> dict[tuple[int, int], list[float]]:
    """First and third quartile of each column of each share's training rows, by (share, column)."""
    each = lambda x: ((s * PLACES + j, f[:, j]) for s, _, f, _, _ in parts(x, shares) for j in range(columns))
    return {divmod(k, PLACES): q for k, q in select_quantiles(grid.rows, grid.columns, each, (0.25, 0.75)).items()}


def rank_correlations(rows: DataFrame, names: list[str], target: str, folds: list[Column]) -> dict[tuple[int, str], float]:
    """Spearman's rho of each column with the target over the rows of each fold where both are known, by (fold, column); one pass over the unpivoted rows.

    Ranks are made of counts of distinct values, so that rows themselves are never sorted together.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in names])
    member = F.explode(F.filter(F.array(*[F.when(f, k) for k, f in enumerate(folds)]), lambda k: k.isNotNull())).alias("fold")
    long = rows.where(F.col(target).isNotNull()).select(F.col(target).alias("y"), pairs.alias("pairs"), member).select("y", "fold", F.inline("pairs")).where("x is not null")

    def ranked(column: str) -> DataFrame:
        counts = long.groupBy("fold", "factor", column).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("fold", "factor").orderBy(column)) - F.col("n")
        return counts.select("fold", "factor", column, (before + (F.col("n") + 1) / 2).alias(f"r{column}"))

    both = long.join(ranked("x"), ["fold", "factor", "x"]).join(ranked("y"), ["fold", "factor", "y"])
    found = both.groupBy("fold", "factor").agg(F.corr("rx", "ry").alias("rho")).collect()  # one row a fold and factor
    return {(r["fold"], r["factor"]): r["rho"] for r in found if r["rho"] is not None}


def factor_table(rows: DataFrame, grid: Grid, shares: list[Share], models: dict[int, Fit], factors: dict[str, list[str]], features: list[str], target: str, folds: list[Column], test: Column, logs: tuple[str, ...] = ()) -> DataFrame:
    """Rows (factor, importance, importance_rank, effect, direction, rho, fold_signs, rho_signs, agreement, consistent, selected).

    target: the target on its own scale; the models learn its log1p.

    shares and models, by number, are those of the folds, whose training rows `folds` name, and last
    those of the model itself. The grid's columns are the features, then the factors as they are.
    importance: growth of the test error, on the target's own scale, when the factor's blocks
    change places; effect: from the first to the third quartile (their logarithms for `logs`); a
    fold agrees if its effect has the sign of its rank correlation and isn't zero. Ranks go by
    importance, then name.
    """
    names, last = list(factors), len(shares) - 1
    spans = quartiles(grid, [Share(s.fold, lambda x: x[:, len(features) :]) for s in shares], len(names))
    rhos = rank_correlations(rows, names, target, folds)
    effects = {}
    for s, fit in models.items():
        for j, c in enumerate(names):
            low, high = (np.log1p(q) if c in logs else q for q in spans[s, j])
            effects[s, c] = effect(Ridge.of(features, fit), factors[c], low, high)
    sign = lambda v: int(np.sign(v))
    signs = {c: [(sign(effects[s, c]), sign(rhos.get((s, c), 0.0))) for s in range(last) if s in models] for c in names}
    back = lambda p: F.greatest(F.lit(0.0), F.expm1(p))
    grown = {r["factor"]: r["importance"] for r in permutation_importance(rows.where(test), Ridge.of(features, models[last]), target, factors, back=back).collect()}
    agreed = {c: float(np.mean([a == b != 0 for a, b in signs[c]])) if signs[c] else 0.0 for c in names}
    table = [(c, float(grown[c] or 0.0), effects[last, c], ("flat", "positive", "negative")[sign(effects[last, c])], rhos.get((last, c)), ",".join(str(a) for a, _ in signs[c]), ",".join(str(b) for _, b in signs[c]), agreed[c], agreed[c] >= AGREE) for c in names]
    out = rows.sparkSession.createDataFrame(table, "factor string, importance double, effect double, direction string, rho double, fold_signs string, rho_signs string, agreement double, consistent boolean")
    ranked = out.withColumn("importance_rank", F.row_number().over(Window.orderBy(F.desc("importance"), "factor")))  # one row a factor
    return ranked.withColumn("selected", (F.col("importance_rank") <= RANKS) & (F.col("importance") > 0) & F.col("consistent"))


def parameter_table(spark: SparkSession, model: Ridge, sources: dict[str, list[str]]) -> DataFrame:
    """Rows (feature, source, coefficient, per_unit, mid, low, high, mean, scale), the intercept first, that give the model's prediction without it."""
    source = {f: c for c, fs in sources.items() for f in fs}
    rows = [("intercept", "constant", model.intercept, model.intercept, None, None, None, None, None)]
    for k, f in enumerate(model.features):
        rows.append((f, source[f], float(model.weights[k]), float(model.weights[k] / model.scale[k]), float(model.mid[k]), float(model.low[k]), float(model.high[k]), float(model.mean[k]), float(model.scale[k])))
    return spark.createDataFrame(rows, "feature string, source string, coefficient double, per_unit double, mid double, low double, high double, mean double, scale double")


def partial_curves(parameters: DataFrame, spans: DataFrame, points: int = 25) -> DataFrame:
    """Rows (factor, value, conditional) from a parameter table and rows (factor, first, last, logs): the prediction along an even grid.

    All features of the factor take the value (logs: log1p of it) together, the others their
    medians; the prediction is at least 0. Both tables have one row a feature or factor.
    """
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    grid = spans.select("factor", "first", "last", "logs", step.alias("_k")).withColumn("value", F.col("first") + (F.col("last") - F.col("first")) * F.col("_k") / (points - 1))
    both = F.broadcast(parameters).crossJoin(grid)
    x = F.when(F.col("source") == F.col("factor"), F.when(F.col("logs"), F.log1p("value")).otherwise(F.col("value"))).otherwise(F.col("mid"))
    term = F.when(F.col("feature") == "intercept", F.col("coefficient")).otherwise((F.least(F.greatest(x, F.col("low")), F.col("high")) - F.col("mean")) / F.col("scale") * F.col("coefficient"))
    summed = both.groupBy("factor", "_k", "value").agg(F.sum(term).alias("total"))
    return summed.select("factor", "value", F.greatest(F.lit(0.0), F.expm1("total")).alias("conditional"))


def weighted_rho(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Spearman's rho of the rows repeated by each column of weights (whole numbers); nan where a side is constant.

    The rank of a value is what lies below it and half of what equals it, from sums over distinct values.
    """

    def ranks(v: np.ndarray) -> np.ndarray:
        _, place = np.unique(v, return_inverse=True)
        sums = np.zeros((place.max() + 1, weights.shape[1]))
        np.add.at(sums, place, weights)
        return (np.cumsum(sums, axis=0) - sums / 2)[place]

    n = weights.sum(axis=0)
    a, b = (r - (weights * r).sum(axis=0) / n for r in (ranks(x), ranks(y)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return (weights * a * b).sum(axis=0) / np.sqrt((weights * a * a).sum(axis=0) * (weights * b * b).sum(axis=0))


def block_intervals(rows: DataFrame, names: list[str], target: str, seed: int, repeats: int = 200, block: int = 12, draws: Callable[[int, int], np.ndarray] | None = None) -> DataFrame:
    """Rows (series_id, factor, rho, low, high, blocks): Spearman's rho of each column with the target, and its 95 % range over draws of whole blocks.

    Blocks are `block` consecutive rows on which both are known; a last one that isn't full takes
    no part in the draws, and with under two blocks there is no range. A draw is a count for each
    block, so no row is copied; draws(repeats, blocks) gives the drawn blocks, a row a draw, else
    they come from the seed and the column's place. A group is one series and factor: its slots, some thousands.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for k, c in enumerate(names)]))
    long = rows.select("series_id", "t_idx", F.col(target).alias("y"), pairs).where("x is not null and y is not null")

    def drawn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t_idx")
        x, y, first = part["x"].to_numpy(), part["y"].to_numpy(), part.iloc[0]
        blocks, ends = len(x) // block, [None, None]
        if blocks >= 2:
            rng = np.random.default_rng(seed + int(first["at"]))
            chosen = rng.integers(0, blocks, (repeats, blocks)) if draws is None else draws(repeats, blocks)
            counts = np.column_stack([np.bincount(row, minlength=blocks) for row in chosen])
            n = blocks * block
            found = weighted_rho(x[:n], y[:n], np.repeat(counts, block, axis=0).astype(float))
            ends = np.quantile(found[~np.isnan(found)], [0.025, 0.975]).tolist() if not np.isnan(found).all() else ends
        rho = float(weighted_rho(x, y, np.ones((len(x), 1)))[0])
        return pd.DataFrame([(first["series_id"], first["factor"], None if np.isnan(rho) else rho, *ends, blocks)], columns=["series_id", "factor", "rho", "low", "high", "blocks"])

    return long.groupBy("series_id", "factor").applyInPandas(drawn, "series_id string, factor string, rho double, low double, high double, blocks int")
