"""Fits against plain numpy over the collected rows of a small table."""

import numpy as np
import pytest

from oriel.operators.recursion import fill_gaps
from oriel.operators.regression import fit_ridge
from oriel.plans import queries as series

SF = "/root/testdata/sf0.001"
FEATURES = [f for fs in series.FACTORS.values() for f in fs]


@pytest.fixture(scope="module")
def frame(spark):
    return series.lagged(spark, SF).toPandas().sort_values("t_idx")


def prepare(train, rows):
    x, y = train[FEATURES].to_numpy(float), rows[FEATURES].to_numpy(float)
    low, mid, high = np.nanpercentile(x, [0.5, 50, 99.5], axis=0)
    x, y = (np.clip(np.where(np.isnan(v), mid, v), low, high) for v in (x, y))
    return (x - x.mean(0)) / x.std(0), (y - x.mean(0)) / x.std(0)


def fit(z, y, ridge, rounds):
    a, w = np.column_stack([np.ones(len(z)), z]), np.ones(len(y))
    for _ in range(rounds):
        beta = np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.diag([0] + [1] * z.shape[1]), a.T @ (w * y))
        off = y - a @ beta
        score = np.abs(off) / max(1.4826 * np.median(np.abs(off - np.median(off))), 1e-8)
        w = np.where(score <= 1.345, 1, 1.345 / np.maximum(score, 1e-300))
    return beta


def test_huber_ridge(spark, frame):
    train = frame[(frame.t_idx < 240) & frame.ntu.notna()]
    beta = fit(prepare(train, train)[0], train.ntu.to_numpy(), 1.0, 5)
    found = {r["feature"]: r["weight"] for r in series.huber_ridge(spark, SF).collect()}
    assert np.allclose([found[f] for f in FEATURES] + [found["intercept"]], [*beta[1:], beta[0]], atol=1e-7)


def test_block_importance(spark, frame):
    found = {r["factor"]: r["importance"] for r in series.block_importance(spark, SF).collect()}
    assert set(found) == set(series.FACTORS) and all(np.isfinite(v) for v in found.values())


def test_feature_without_values_and_no_rows(spark):
    rows = spark.createDataFrame([(float(k % 7), None, float(2 * (k % 7))) for k in range(50)], "a double, b double, y double")
    model = fit_ridge(rows, ["a", "b"], "y", 1e-9)
    assert np.isclose(rows.select(model.predict().alias("p"), "y").toPandas().eval("abs(p - y)").max(), 0, atol=1e-6)
    with pytest.raises(ValueError):
        fit_ridge(rows.where("false"), ["a"], "y", 1.0)


def test_gaps_at_the_start_and_empty(spark):
    rows = spark.createDataFrame([("s", 0, None, 1.0), ("s", 1, 10.0, None), ("s", 2, None, None), ("s", 3, None, 20.0)], "series_id string, t_idx long, y double, x double")
    found = {r["t_idx"]: r["filled"] for r in fill_gaps(rows, "y", "x").collect()}
    assert found[0] is None and found[1] == 10 and found[2] == pytest.approx(10) and found[3] == pytest.approx(11)
    assert fill_gaps(rows.where("false"), "y", "x").count() == 0
