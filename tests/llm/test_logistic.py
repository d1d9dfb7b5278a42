"""The sparse logistic fit against the gradient of its loss over the whole matrix."""

import numpy as np
import pytest

from oriel.llm import toxicity


@pytest.mark.parametrize("at_once", [1 << 18, 100, 7])
def test_gradient_vanishes(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
    rng, n, width = np.random.default_rng(0), 400, 50
    sizes = rng.integers(0, 20, n)
    sizes[-1] = 0
    columns, ratio, labels = rng.integers(0, width, sizes.sum()).astype(np.int32), rng.normal(size=width), (rng.random(n) < 0.3).astype(float)
    x = np.zeros((n, width))
    np.add.at(x, (np.repeat(np.arange(n), sizes), columns), ratio[columns])
    w, b = toxicity.fit_logistic(columns, sizes, ratio, labels, 1e-2, 3000)
    off = 1 / (1 + np.exp(-(x @ w + b))) - labels
    assert np.abs(x.T @ off / n + 1e-2 * w).max() < 1e-10 and abs(off.mean()) < 1e-10
