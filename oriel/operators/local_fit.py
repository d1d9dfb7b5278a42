"""Ridge and Huber fits of one group's rows inside a task, for many small models side by side."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rounds of reweighting, and the residual (in robust scales) from which a row weighs less.
HUBER_ROUNDS, HUBER_AT = 5, 1.345


@dataclass
class Fit:
    """Bounds and medians of the raw features, then weights of the standardised ones."""

    low: np.ndarray
    mid: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(np.where(np.isnan(x), self.mid, x), self.low, self.high) - self.mean) / self.scale

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.intercept + self.standard(x) @ self.weights

    def numbers(self) -> np.ndarray:
        return np.concatenate([self.low, self.mid, self.high, self.mean, self.scale, self.weights, [self.intercept]])

    @staticmethod
    def of(numbers: np.ndarray) -> Fit:
        parts = np.split(np.asarray(numbers[:-1], float), 6)
        return Fit(*parts, float(numbers[-1]))


def fit(x: np.ndarray, y: np.ndarray, ridge: float, robust: bool = True) -> Fit:
    """As regression.fit_ridge(), over rows in memory: nan is a gap, a feature without values counts as 0."""
    known = ~np.isnan(x)
    filled = np.where(known.any(axis=0), x, 0.0)
    low, mid, high = np.nanpercentile(filled, [0.5, 50, 99.5], axis=0)
    model = Fit(low, mid, high, np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1]), 0.0)
    clean = model.standard(x)
    model.mean, model.scale = clean.mean(axis=0), clean.std(axis=0)
    model.scale[model.scale < 1e-10] = 1.0
    z = np.column_stack([np.ones(len(x)), (clean - model.mean) / model.scale])
    penalty, weight = ridge * np.diag([0.0] + [1.0] * x.shape[1]), np.ones(len(x))
    for left in reversed(range(HUBER_ROUNDS if robust else 1)):
        found = np.linalg.solve(z.T @ (z * weight[:, None]) + penalty, z.T @ (weight * y))
        if left:
            off = y - z @ found
            score = np.abs(off) / max(1.4826 * np.median(np.abs(off - np.median(off))), 1e-8)
            weight = np.where(score <= HUBER_AT, 1.0, HUBER_AT / np.maximum(score, HUBER_AT))
    model.weights, model.intercept = found[1:], float(found[0])
    return model
