"""Grids of ridge and Huber models that are fitted and judged side by side.

A grid is a list of shares: what models have in common but for their ridge, that is their
features and their fold. Bounds, medians and standardisation are those of each share's own
training rows. All shares go through the same few passes over the rows: one for the bounds, one
for the sums that give every model, two for each round of reweighting, and one that predicts
with all models at once and adds up their errors on the scale of the target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel.operators.local_fit import HUBER_AT, HUBER_ROUNDS, Fit
from oriel.operators.passes import TOLD_APART, medians_and_spreads, quantiles, sum_arrays

#: Keys of streams: a share's number times this, and a feature's or a ridge's.
PLACES = 4096
BOUNDS = (0.005, 0.5, 0.995)


@dataclass(frozen=True)
class Share:
    """Rows with cell < fold train, rows with cell = fold are judged.

    make: the features from the grid's columns. filled: gaps take the training median; else rows with gaps are left out.
    """

    fold: int
    make: Callable[[np.ndarray], np.ndarray]
    filled: bool = True


@dataclass(frozen=True)
class Score:
    n: int
    rmse: float
    mae: float
    r2: float | None


def raw(x: np.ndarray) -> np.ndarray:
    return x


def parts(x: np.ndarray, shares: list[Share], judged: bool = False) -> Iterator[tuple[int, Share, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a batch: number, share, features, target and actual of the rows that train it, or that it is judged by."""
    made: dict[Callable, np.ndarray] = {}
    for s, share in enumerate(shares):
        own = x[:, 0] == share.fold if judged else x[:, 0] < share.fold
        if not own.any():
            continue
        if share.make not in made:
            made[share.make] = share.make(x[:, 3:])
        features = made[share.make]
        if not share.filled:
            own &= ~np.isnan(features).any(axis=1)
        yield s, share, features[own], x[own, 1], x[own, 2]


class Grid:
    """Rows of a grid: cell (0: trains every fold, k: judged by fold k and trains later ones, null: neither), target, and columns.

    Models learn the target as it is; `actual` is the target on its own scale, and `back` leads
    from the one to the other. Rows without a target or cell take no part.
    """

    def __init__(self, rows: DataFrame, cell: Column, target: Column, actual: Column, columns: list[Column], back: Callable[[np.ndarray], np.ndarray] = lambda p: np.maximum(0.0, np.expm1(p)), told_apart: int = TOLD_APART) -> None:
        self.rows, self.back, self.told_apart = rows.where(cell.isNotNull() & target.isNotNull()), back, told_apart
        self.columns = [cell, target, actual, *columns]

    def bounds(self, shares: list[Share]) -> list[np.ndarray]:
        """Low, mid and high of each share's features; those without values have 0. An empty array where no row trains a share."""
        each = lambda x: ((s * PLACES + j, f[:, j]) for s, _, f, _, _ in parts(x, shares) if len(f) for j in range(f.shape[1]))
        found = quantiles(self.rows, self.columns, each, BOUNDS, self.told_apart)
        widths = np.bincount(np.array([k // PLACES for k in found], int), minlength=len(shares))
        return [np.nan_to_num(np.array([found[s * PLACES + j] for j in range(w)]).reshape(w, 3).T) for s, w in enumerate(widths)]

    def fit(self, shares: list[Share], ridges: tuple[float, ...], robust: bool = False) -> dict[tuple[int, int], Fit]:
        """Models by (number of the share, number of the ridge); shares that no row trains have none."""
        bounds = self.bounds(shares)

        def shifted(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            for s, _, f, y, _ in parts(x, shares):
                if bounds[s].size:
                    low, mid, high = bounds[s]
                    z = np.column_stack([np.ones(len(f)), np.clip(np.where(np.isnan(f), mid, f), low, high) - mid, y])
                    yield s, z.T @ z

        models: dict[tuple[int, int], Fit] = {}
        for s, sums in sum_arrays(self.rows, self.columns, shifted).items():
            n, mean = sums[0, 0], sums[0, 1:-1] / sums[0, 0]
            scale = np.sqrt(np.maximum(np.diag(sums)[1:-1] / n - mean**2, 0.0))
            scale[scale < 1e-10] = 1.0
            turn = np.diag(np.r_[1.0, 1 / scale, 1.0])
            turn[1:-1, 0] = -mean / scale
            low, mid, high = bounds[s]
            for r, ridge in enumerate(ridges):
                beta = _normal(turn @ sums @ turn.T, ridge)
                models[s, r] = Fit(low, mid, high, mid + mean, scale, beta[1:], float(beta[0]))
        for _ in range(HUBER_ROUNDS - 1 if robust else 0):
            models = self.reweighted(shares, ridges, models)
        return models

    def reweighted(self, shares: list[Share], ridges: tuple[float, ...], models: dict[tuple[int, int], Fit]) -> dict[tuple[int, int], Fit]:
        """The models after a round in which rows that lie far off (by each model's own robust scale) weigh less."""

        def off(x: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
            for s, _, f, y, _ in parts(x, shares):
                own = [r for r in range(len(ridges)) if (s, r) in models]
                if own:
                    z = np.column_stack([np.ones(len(f)), models[s, own[0]].standard(f)])
                    for r in own:
                        yield s, r, z, y, y - z @ np.r_[models[s, r].intercept, models[s, r].weights]

        spread = medians_and_spreads(self.rows, self.columns, lambda x: ((s * PLACES + r, e) for s, r, _, _, e in off(x)), self.told_apart)

        def weighted(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            for s, r, z, y, e in off(x):
                score = np.abs(e) / max(1.4826 * spread[s * PLACES + r][1], 1e-8)
                both = np.column_stack([z, y])
                yield s * PLACES + r, both.T @ (both * np.where(score <= HUBER_AT, 1.0, HUBER_AT / np.maximum(score, HUBER_AT))[:, None])

        out = {}
        for key, sums in sum_arrays(self.rows, self.columns, weighted).items():
            s, r = divmod(key, PLACES)
            beta, old = _normal(sums, ridges[r]), models[s, r]
            out[s, r] = Fit(old.low, old.mid, old.high, old.mean, old.scale, beta[1:], float(beta[0]))
        return out

    def scores(self, shares: list[Share], models: dict[tuple[int, int], Fit]) -> dict[tuple[int, int], Score]:
        """How each model does on the rows that its share is judged by; those without rows have none."""
        back, by_share = self.back, {}
        for s, r in sorted(models):
            by_share.setdefault(s, []).append(r)

        def each(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            for s, _, f, _, actual in parts(x, shares, judged=True):
                if s in by_share and len(f):
                    first = models[s, by_share[s][0]]
                    w = np.column_stack([np.r_[models[s, r].intercept, models[s, r].weights] for r in by_share[s]])
                    e = back(w[0] + first.standard(f) @ w[1:]) - actual[:, None]
                    plain = np.array([len(f), actual.sum(), (actual**2).sum()])
                    yield s, np.concatenate([plain, (e**2).sum(0), np.abs(e).sum(0)])

        out = {}
        for s, sums in sum_arrays(self.rows, self.columns, each).items():
            n, total, squared = sums[:3]
            for k, r in enumerate(by_share[s]):
                se, ae = sums[3 + k], sums[3 + len(by_share[s]) + k]
                about = squared - total**2 / n
                out[s, r] = Score(int(n), float(np.sqrt(se / n)), float(ae / n), float(1 - se / about) if about > 1e-12 * squared else None)
        return out


def _normal(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Intercept, which isn't penalised, and weights from the sums of products of (1, z, y)."""
    return np.linalg.solve(sums[:-1, :-1] + ridge * np.diag([0.0] + [1.0] * (len(sums) - 2)), sums[:-1, -1])


def mean_errors(shares: list[tuple[object, Share]], ridges: tuple[float, ...], grid: Grid, robust: bool = False) -> dict[tuple[object, float], float]:
    """Mean RMSE over the folds by (name, ridge); shares of one name are its folds, and folds without rows don't count."""
    plain = [s for _, s in shares]
    found: dict[tuple[object, float], list[float]] = {}
    for (s, r), score in sorted(grid.scores(plain, grid.fit(plain, ridges, robust)).items()):
        found.setdefault((shares[s][0], ridges[r]), []).append(score.rmse)
    return {k: float(np.mean(v)) for k, v in found.items()}


def cosine_features(fit: Fit, spread: float, seed: int, count: int = 256) -> Callable[[np.ndarray], np.ndarray]:
    """Random Fourier features of standardised columns: normal weights of variance 2 * spread, even phases."""
    draw = np.random.default_rng(seed)
    w, phase = draw.normal(0.0, np.sqrt(2 * spread), (len(fit.mean), count)), draw.uniform(0.0, 2 * np.pi, count)
    return lambda x: np.sqrt(2 / count) * np.cos(fit.standard(x) @ w + phase)


def median_spread(points: np.ndarray) -> float:
    """1 / (2 * median squared distance) over all pairs of a sample; distances of zero don't count, without others 0.5."""
    squares = (points**2).sum(1)
    d = (squares[:, None] + squares - 2 * points @ points.T)[np.triu_indices(len(points), 1)]
    d = d[d > 1e-12]
    return 1 / (2 * float(np.median(d))) if len(d) else 0.5


def sampled(grid: Grid, folds: list[int], key: Column, seed: int, most: int = 1000) -> dict[int, np.ndarray]:
    """Of each fold's training rows the `most` with the least hashes of seed + fold and key, as a matrix of the grid's columns."""
    out = {}
    for fold in folds:
        h = F.xxhash64(F.lit(seed + fold), key)
        chosen = grid.rows.where(grid.columns[0] < fold).select(h.alias("_h"), *[c.cast("double").alias(f"x{k}") for k, c in enumerate(grid.columns[3:])])
        rows = chosen.orderBy("_h", *[f"x{k}" for k in range(len(grid.columns) - 3)]).limit(most).collect()  # `most` rows
        out[fold] = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float).reshape(len(rows), len(grid.columns) - 3)
    return out
