"""Forecast, factor and search queries against plain numpy loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.calendar import regular_slots
from oriel.operators.factors import partial_curves
from oriel.operators.horizons import fan, fill_gaps_by_model, gate_vectors, horizon_samples, path_grades, scenario_forecasts, simulate_paths, with_filled
from oriel.operators.local_fit import Fit, fit
from oriel.operators.regression import fit_ridge
from oriel.operators.state import STATE_NAMES, with_physical, with_state
from oriel.plans import forecast, frames, searches
from oriel.plans.forecast import ENDS, FOLDS, FREE, ORIGINS, TEST_FROM
from oriel.sources import read_table

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    """(states, samples, models, errors) as DataFrames, and the states as a pandas frame in order."""
    found = forecast._fitted(spark, SMALL)
    return found, found[0].toPandas().sort_values("t_idx").reset_index(drop=True)


def brute_fit(x, y, ridge):
    """The Huber ridge written out with least squares of stacked rows instead of normal equations."""
    x = np.where(np.isnan(x).all(axis=0), 0.0, x)
    low, mid, high = (np.nanpercentile(x, p, axis=0) for p in (0.5, 50, 99.5))
    clean = lambda v: np.clip(np.where(np.isnan(v), mid, v), low, high)
    mean, scale = clean(x).mean(axis=0), clean(x).std(axis=0)
    scale[scale < 1e-10] = 1
    z, w = (clean(x) - mean) / scale, np.ones(len(y))
    for _ in range(5):
        root = np.sqrt(w)
        a = np.vstack([np.column_stack([np.ones(len(y)), z]) * root[:, None], np.column_stack([np.zeros(z.shape[1]), np.sqrt(ridge) * np.eye(z.shape[1])])])
        beta = np.linalg.lstsq(a, np.r_[y * root, np.zeros(z.shape[1])], rcond=None)[0]
        off = y - beta[0] - z @ beta[1:]
        score = np.abs(off) / max(1.4826 * np.median(np.abs(off - np.median(off))), 1e-8)
        w = np.where(score <= 1.345, 1, 1.345 / np.maximum(score, 1e-300))
    return lambda v: beta[0] + ((clean(v) - mean) / scale) @ beta[1:]


def test_local_fit_equals_the_distributed_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = np.nansum(x, axis=1) + rng.standard_t(2, 300)
    rows = spark.createDataFrame([(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    one, other, brute = fit_ridge(rows, ["a", "b", "c"], "y", 3.0, robust=True), fit(x, y, 3.0), brute_fit(x, y, 3.0)
    assert np.allclose(one.weights, other.weights) and np.isclose(one.intercept, other.intercept) and np.allclose(brute(x), other.predict(x))
    assert np.allclose(Fit.of(other.numbers()).predict(x), other.predict(x))


def test_samples_and_models(fitted):
    (_, samples, models, _), states = fitted
    got = samples.toPandas()
    y, known = states["ntu"].to_numpy(float), states["available"].to_numpy(bool)
    wanted = {(t, h) for t in range(len(y)) for h in range(1, 7) if known[t] and t + h < len(y) and np.isfinite(y[t + h]) and np.isfinite(states.at[t, f"ahead{h}"])}
    assert set(zip(got["t_idx"], got["horizon"], strict=True)) == wanted
    x = states[STATE_NAMES].to_numpy(float)
    for row in models.where("model = 'final'").toPandas().itertuples():
        keys = sorted(t for t, h in wanted if h == row.horizon)
        at, base = np.array(keys) + row.horizon, np.log1p([states.at[t, f"ahead{row.horizon}"] for t in keys])
        target, scores = np.log1p(y[at]) - base, []
        for ridge in (0.01, 0.1, 1.0, 10.0, 100.0):
            errors = []
            for start, end in FOLDS:
                train, valid = at < start, (at >= start) & (at < end)
                made = np.maximum(0, np.expm1(base[valid] + brute_fit(x[np.array(keys)[train]], target[train], ridge)(x[np.array(keys)[valid]])))
                errors.append(np.sqrt(np.mean((made - y[at[valid]]) ** 2)))
            scores.append((np.mean(errors), ridge))
        assert row.ridge == min(scores)[1] and np.isclose(row.rmse, min(scores)[0], rtol=1e-5)
        last = brute_fit(x[np.array(keys)[at < ENDS["final"]]], target[at < ENDS["final"]], row.ridge)
        assert np.allclose(Fit.of(row.numbers).predict(x[:50]), last(x[:50]), atol=1e-6)


def model_of(models, horizon, kind="final"):
    return Fit.of(models.where((F.col("model") == kind) & (F.col("horizon") == horizon)).first()["numbers"])


def brute_filled(states, models, free=None):
    """Target, residuals and state vectors after one loop over the whole series, where the operator walks stretches."""
    m, y, x = model_of(models, 1), states["ntu"].to_numpy(float).copy(), states[STATE_NAMES].to_numpy(float).copy()
    if free:
        y[free[0] : free[1]] = np.nan
    physical, base = states["physical"].to_numpy(float), np.log1p(states["ahead1"].to_numpy(float))
    r = np.log1p(y) - np.log1p(physical)
    for t in range(1, len(y)):
        if np.isnan(y[t]) and np.isfinite(base[t - 1]):
            v = x[t - 1].copy()
            v[:6] = [r[t - 1 - k] if t - 1 - k >= 0 else np.nan for k in range(6)]
            y[t] = max(0, np.expm1(base[t - 1] + m.predict(v[None])[0]))
            r[t] = np.log1p(y[t]) - np.log1p(physical[t])
    for k in range(6):
        x[:, k] = np.r_[np.full(k, np.nan), r[: len(r) - k]]
    return y, r, x


@pytest.mark.parametrize("free", [None, FREE])
def test_gaps_are_filled_in_order(fitted, free):
    (states_df, _, models, _), states = fitted
    y, r, _ = brute_filled(states, models, free)
    got = fill_gaps_by_model(states_df, models, free=free).toPandas().sort_values("t_idx")
    assert np.isnan(states["ntu"]).sum() > 5 and np.allclose(got["filled"].to_numpy(float), y, equal_nan=True) and np.allclose(got["residual"].to_numpy(float), r, equal_nan=True)


def test_free_days_dont_read_what_is_observed(fitted):
    """A month of blank targets: the same values, and all forecasts of these days, though no target is known."""
    (states_df, _, models, errors), _ = fitted
    inside = (F.col("t_idx") >= FREE[0]) & (F.col("t_idx") < FREE[1])
    blank = states_df.withColumns({c: F.when(~inside, F.col(c)) for c in ("ntu", "residual")})
    by = Window.partitionBy("series_id").orderBy("t_idx")
    blank = blank.withColumns({f"residual_lag{k}": F.lag("residual", k).over(by) if k else F.col("residual") for k in range(6)}).withColumn("available", F.count("residual").over(by.rowsBetween(-5, 0)) == 6)
    filled = [fill_gaps_by_model(s, models, free=FREE).toPandas().sort_values("t_idx") for s in (states_df, blank)]
    assert np.allclose(*[f[["filled", "residual"]].to_numpy(float) for f in filled], equal_nan=True)
    whole = with_filled(blank, fill_gaps_by_model(blank, models, free=FREE))
    rows = scenario_forecasts(whole, models, ORIGINS, forecast.SCENARIOS).collect()
    assert len(rows) == 72 and all(r["base_value"] is not None and r["scenario_value"] is not None for r in rows)
    paths = simulate_paths(whole, models, errors, FREE[0], FREE[1], 4, forecast.DESIGNATED).where("horizon = 6").toPandas()
    assert set(forecast.DESIGNATED) <= set(paths["t_idx"]) and len(set(forecast.DESIGNATED)) == 21


def test_backtest(spark, fitted):
    (_, _, models, errors), states = fitted
    got = forecast.horizon_backtest(spark, SMALL).toPandas().set_index(["horizon_hours", "model"])
    filled, r, x = brute_filled(states, models, FREE)
    vectors, y = np.stack(errors.toPandas()["errors"]), states["ntu"].to_numpy(float)
    assert len(vectors) >= 20
    for h in range(1, 7):
        keys = [t for t in range(TEST_FROM, len(y) - h) if np.isfinite(r[t - 5 : t + 1]).all() and np.isfinite(y[t + h])]
        m, actual = model_of(models, h), y[np.array(keys) + h]
        logs = np.log1p(states.loc[keys, f"ahead{h}"].to_numpy()) + m.predict(x[keys])
        low, high = (np.maximum(0, np.expm1(logs + np.quantile(vectors[:, h - 1], q))) for q in (0.025, 0.975))
        made = {"hybrid": np.maximum(0, np.expm1(logs)), "persistence": filled[keys], "physical": states.loc[keys, f"ahead{h}"].to_numpy()}
        rmse = {k: np.sqrt(np.mean((v - actual) ** 2)) for k, v in made.items()}
        for k, v in made.items():
            row = got.loc[(2 * h, k)]
            assert row["n"] == len(keys) and np.isclose(row["rmse"], rmse[k]) and np.isclose(row["mae"], np.mean(np.abs(v - actual)))
            assert np.isclose(row["r2"], 1 - np.sum((v - actual) ** 2) / np.sum((actual - actual.mean()) ** 2))
        assert np.isclose(got.loc[(2 * h, "hybrid")]["coverage"], np.mean((actual >= low) & (actual <= high))) and got.loc[(2 * h, "hybrid")]["beats_persistence"] == (rmse["hybrid"] < rmse["persistence"])


def test_paths(fitted):
    """Each path by a loop of its own; before the start the filled residuals count."""
    (states_df, _, models, errors), states = fitted
    start, origins = FREE[0], (FREE[0] - 4, FREE[0] + 12)
    whole = with_filled(states_df, fill_gaps_by_model(states_df, models, free=FREE))
    got = simulate_paths(whole, models, errors, start, 330, 20, origins).toPandas().set_index(["path", "t_idx", "horizon"])["y"]
    vectors = np.stack(errors.toPandas().sort_values("t_idx")["errors"])
    _, r, x = brute_filled(states, models, FREE)
    logs, fits = np.log1p(states["physical"].to_numpy(float)), {h: model_of(models, h) for h in range(1, 7)}
    for path in (0, 7, 19):
        own = r.copy()
        for t in range(start - 6, start + 14):
            step = t - start + 6
            e = vectors[((path * 48271 + step // 12 * 69621 + 12345) * 16807 % 2147483647 + step % 12) % len(vectors)]
            v = x[t].copy()
            v[:6] = own[t - np.arange(6)]
            make = lambda h: max(0, np.expm1(np.log1p(states.at[t, f"ahead{h}"]) + fits[h].predict(v[None])[0] + e[h - 1]))  # noqa: B023, E731
            if t in origins:
                assert all(np.isclose(got[path, t, h], make(h)) for h in range(1 if t >= start - 1 else 2, 7))
            if t >= start - 1:
                assert np.isclose(got[path, t, 1], make(1))
                own[t + 1] = np.log1p(make(1)) - logs[t + 1]
            else:
                assert (path, t, 1) not in got.index


def test_designated_forecasts(spark):
    got = forecast.designated_forecasts(spark, SMALL).toPandas()
    assert sorted(got["at"]) == sorted(d + k for d in ORIGINS for k in range(7)) and (got["paths"] == 500).all()
    assert ((got["low"] <= got["mid"]) & (got["mid"] <= got["high"])).all() and np.allclose(got["correction"], got["mid"] - got["hydraulic"])


def test_fan_and_grades(spark):
    rng = np.random.default_rng(4)
    y = {(p, t, h): float(rng.uniform(20, 90)) for p in range(40) for t in (9, 10) for h in range(1, 7) if t == 10 or h == 1}
    rows = spark.createDataFrame([("s", p, t, h, v) for (p, t, h), v in y.items()], "series_id string, path long, t_idx long, horizon long, y double")
    got = {r["hours"]: r for r in fan(rows, (10,)).collect()}
    even = {0: [y[p, 9, 1] for p in range(40)]} | {2 * h: [y[p, 10, h] for p in range(40)] for h in range(1, 7)}
    for hour in range(1, 13):
        values = even[hour] if hour % 2 == 0 else np.expm1((np.log1p(even[hour - 1]) + np.log1p(even[hour + 1])) / 2)
        assert np.allclose([got[hour][c] for c in ("low", "mid", "high")], np.quantile(values, [0.025, 0.5, 0.975])) and got[hour]["interpolated"] == bool(hour % 2)
    days = spark.createDataFrame([("s", p, "d", t, v) for p in range(60) for t, v in enumerate(rng.uniform(30, 55 + p, 12).tolist())], "series_id string, path long, op_day string, t_idx long, y double")
    codes = []
    for _, day in days.toPandas().groupby("path"):
        v, longest, run = day.sort_values("t_idx")["y"].to_numpy(), 0, 0
        for above in v > 55:
            run = run + 1 if above else 0
            longest = max(longest, run)
        a = max(v.max() - 55, 0)
        codes.append(0 if a <= 0 else 1 if a <= 10 and 2 * longest <= 4 else 2 if a <= 20 and 2 * longest <= 8 else 3)
    row, names = path_grades(days).first(), ("SAFE", "LOW", "MEDIUM", "HIGH")
    share = [codes.count(k) / 60 for k in range(4)]
    assert np.allclose([row[n.lower()] for n in names], share) and row["modal"] == names[int(np.argmax(share))]
    assert [row["grade_low"], row["grade_high"]] == [names[int(q)] for q in np.quantile(codes, [0.025, 0.975], method="nearest")]


def test_scenarios(spark, fitted):
    (_, _, models, _), states = fitted
    got = forecast.scenario_sensitivity(spark, SMALL).toPandas()
    assert len(got) == 72 and set(got["t_idx"]) == set(ORIGINS)
    x = brute_filled(states, models, FREE)[2]
    for r in got.itertuples():
        v, base = x[r.t_idx].copy(), np.log1p(states.at[r.t_idx, f"ahead{r.horizon}"])
        m = model_of(models, r.horizon)
        own = max(0, np.expm1(base + m.predict(v[None])[0]))
        column, fraction = r.scenario.split(" ")[0], float(r.scenario.split(" ")[1].rstrip("%")) / 100
        if column == "rw":
            v[STATE_NAMES.index("log_rw")] = np.log1p(states.at[r.t_idx, "rw"] * (1 + fraction))
            v[STATE_NAMES.index("delta_log_rw")] = v[STATE_NAMES.index("log_rw")] - v[STATE_NAMES.index("log_rw_lag1")]
        else:
            v[STATE_NAMES.index("alum")] *= 1 + fraction
        made = max(0, np.expm1(base + m.predict(v[None])[0]))
        assert np.isclose(r.base_value, own) and np.isclose(r.scenario_value, made) and (own == 0 or np.isclose(r.elasticity, (made - own) / own / fraction, atol=1e-7))


def test_too_few_vectors_raise(spark):
    rows = spark.createDataFrame([("a", k, [0.0] * 6) for k in range(5)], "series_id string, t_idx long, errors array<double>")
    assert gate_vectors(rows, 5).count() == 5
    with pytest.raises(Exception, match="too few joint error vectors"):
        gate_vectors(rows, 6).collect()


def test_two_series_run_side_by_side(spark):
    """Each of two series has what it has alone."""
    events = read_table(spark, SMALL, "events")
    whole = regular_slots(events, "if(event_id % 3 = 0, 'a', 'b')")
    alone = [regular_slots(events.where(w), f"'{n}'") for n, w in (("a", "event_id % 3 = 0"), ("b", "event_id % 3 != 0"))]
    key = lambda df: sorted(map(str, df.select("series_id", "t_idx", *[F.round(c, 9) for c in [*STATE_NAMES, "tau", "physical", "ahead6"]]).collect()))
    made = lambda slots: with_state(with_physical(slots))
    assert key(made(whole)) == sorted(key(made(alone[0])) + key(made(alone[1])))
    both, apart = horizon_samples(made(whole)).count(), sum(horizon_samples(made(s)).count() for s in alone)
    assert both == apart


@pytest.mark.parametrize("name", sorted(set(frames.QUERIES) - {"timeline_gate"}))
def test_frames_of_two_series(spark, monkeypatch, name):
    events = read_table(spark, SMALL, "events")
    table = {"both": regular_slots(events, "if(event_id % 3 = 0, 'a', 'b')"), "a": regular_slots(events.where("event_id % 3 = 0"), "'a'"), "b": regular_slots(events.where("event_id % 3 != 0"), "'b'")}
    monkeypatch.setattr(frames, "_slots", lambda spark, which, series: table[which])
    rows = {k: sorted(map(str, frames.QUERIES[name](spark, k).collect())) for k in table}
    assert rows["both"] == sorted(rows["a"] + rows["b"])


def test_partial_curves_replay_the_model(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(*map(float, r), float(r @ [0.1, -0.2, 0.05])) for r in rng.normal(size=(200, 3))], "a double, a_lag1 double, b double, y double")
    model, sources = fit_ridge(rows, ["a", "a_lag1", "b"], "y", 1.0), {"a": ["a", "a_lag1"], "b": ["b"]}
    table = searches.parameter_table(spark, model, sources)
    curves = partial_curves(table, spark.createDataFrame([("a", -1.0, 1.0, False), ("b", 0.0, 2.0, True)], "factor string, first double, last double, logs boolean")).toPandas()
    assert len(curves) == 50
    for r in curves.itertuples():
        assert np.isclose(r.conditional, max(0, np.expm1(model.at(**dict.fromkeys(sources[r.factor], np.log1p(r.value) if r.factor == "b" else r.value)))))
