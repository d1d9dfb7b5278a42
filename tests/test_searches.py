"""Searches and factor queries against plain loops over the collected rows: every fit with its own bounds, chosen by the error of the target itself."""

from itertools import product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oriel.operators import passes
from oriel.plans import searches as S

SF = "/root/testdata/sf0.01"


def model(x, y, ridge, robust=False):
    """Predictions by a ridge on cut, filled and standardised features, reweighted in five rounds."""
    known = np.where(np.isnan(x).all(axis=0), 0.0, x)
    low, mid, high = (np.nanpercentile if np.isnan(known).any() else np.percentile)(known, [0.5, 50, 99.5], axis=0)
    clean = lambda v: np.clip(np.where(np.isnan(v), mid, v), low, high)
    mean, scale = clean(x).mean(axis=0), clean(x).std(axis=0)
    scale[scale < 1e-10] = 1.0
    design = lambda v: np.column_stack([np.ones(len(v)), (clean(v) - mean) / scale])
    a, w = design(x), np.ones(len(x))
    for _ in range(5 if robust else 1):
        beta = np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.diag([0.0] + [1.0] * x.shape[1]), a.T @ (w * y))
        off = y - a @ beta
        score = np.abs(off) / max(1.4826 * np.median(np.abs(off - np.median(off))), 1e-8)
        w = np.where(score <= 1.345, 1.0, 1.345 / np.maximum(score, 1e-12))
    predict = lambda v: design(v) @ beta
    predict.design, predict.beta, predict.mid = (lambda v: design(v)[:, 1:]), beta, mid
    return predict


def back(p):
    return np.maximum(0.0, np.expm1(p))


def rmse(a, b):
    return float(np.sqrt(np.mean((a - b) ** 2)))


@pytest.fixture(scope="module")
def rows(spark):
    """The slots with what is known of the target, and their features made in pandas."""
    slots = S.designed(spark, SF).select("series_id", "t_idx", "ts", "op_day", "ntu", *S.SERIES).toPandas().sort_values("t_idx").reset_index(drop=True)
    for c, k in product(S.SERIES, (0, 1, 2, 3, 6)):
        slots[f"{c}_lag{k}"] = (np.log1p(slots[c]) if c in ("filt", "rw") else slots[c]).shift(k)
    for k in range(1, 13):
        slots[f"y_lag{k}"] = np.log1p(slots["ntu"]).shift(k)
    hour, day = slots["ts"].dt.hour + slots["ts"].dt.minute / 60, slots["ts"].dt.dayofyear
    slots["hour_sin"], slots["hour_cos"], slots["year_sin"], slots["year_cos"] = np.sin(2 * np.pi * hour / 24), np.cos(2 * np.pi * hour / 24), np.sin(2 * np.pi * day / 365.25), np.cos(2 * np.pi * day / 365.25)
    return slots


@pytest.fixture(scope="module")
def factor(rows):
    """Features, log target, target, positions; and the chosen ridge by the loop."""
    known = rows[rows["ntu"].notna()]
    x, actual, t = known[S.FEATURES].to_numpy(float), known["ntu"].to_numpy(), known["t_idx"].to_numpy()
    found = [(float(np.mean([rmse(actual[(t >= a) & (t < b)], back(model(x[t < a], np.log1p(actual[t < a]), r, True)(x[(t >= a) & (t < b)]))) for a, b in S.FOLDS])), r) for r in S.RIDGES]
    return x, np.log1p(actual), actual, t, found, min(found)[1]


def test_ridge_search(spark, factor):
    got = {r["ridge"]: (r["rmse"], r["best"]) for r in S.ridge_search(spark, SF).collect()}
    assert len(got) == 5
    for e, r in factor[4]:
        assert np.isclose(got[r][0], e, rtol=1e-8) and got[r][1] == (r == factor[5])


def test_cosine_grid(spark, factor):
    x, y, actual, t, *_ = factor
    found = []
    for width, ridge in product(S.WIDTHS, S.RIDGES):
        errors = []
        for k, (a, b) in enumerate(S.FOLDS):
            plain = model(x[t < a], y[t < a], 1.0)
            z = plain.design(x[t < a])
            d = ((z[:, None] - z[None]) ** 2).sum(2)[np.triu_indices(len(z), 1)]
            rng = np.random.default_rng(S.SEED + k)
            w, phase = rng.normal(0.0, np.sqrt(2 * width / (2 * np.median(d[d > 1e-12]))), (z.shape[1], 256)), rng.uniform(0.0, 2 * np.pi, 256)
            cosines = lambda v, w=w, phase=phase, plain=plain: np.sqrt(2 / 256) * np.cos(plain.design(v) @ w + phase)
            valid = (t >= a) & (t < b)
            errors.append(rmse(actual[valid], back(model(cosines(x[t < a]), y[t < a], ridge)(cosines(x[valid])))))
        found.append((float(np.mean(errors)), ridge, width))
    got = {(r["ridge"], r["width"]): (r["rmse"], r["best"]) for r in S.cosine_grid(spark, SF).collect()}
    assert len(got) == 15
    for e, ridge, width in found:
        assert np.isclose(got[ridge, width][0], e, rtol=1e-6) and got[ridge, width][1] == ((e, ridge, width) == min(found))


def delay_design(rows, delays, order):
    v = {c: rows[f"{c}_lag{d}"].to_numpy() for c, d in zip(S.DELAYED, delays)}
    out = [rows[f"y_lag{k}"].to_numpy() for k in range(1, order + 1)] + list(v.values()) + [x**2 for x in v.values()] + [v["rw"] * v["alum"], v["ph"] * v["alum"]]
    return np.column_stack(out)


def searched(rows, delays, order):
    x, actual, t = delay_design(rows, delays, order), rows["ntu"].to_numpy(), rows["t_idx"].to_numpy()
    whole = ~np.isnan(x).any(axis=1) & ~np.isnan(actual)
    for ridge in S.RIDGES:
        errors = []
        for a, b in S.FOLDS:
            train, valid = whole & (t < a), whole & (t >= a) & (t < b)
            if train.any() and valid.any():
                errors.append(rmse(actual[valid], back(model(x[train], np.log1p(actual[train]), ridge)(x[valid]))))
        if errors:
            yield ridge, float(np.mean(errors))


@pytest.fixture(scope="module")
def delays(rows):
    found = {(d, ridge): e for d in product(range(4), repeat=4) for ridge, e in searched(rows, d, 3)}
    return found, min(found, key=lambda k: (found[k], sum(k[0]), k[0], k[1]))


def test_delay_search(spark, delays):
    found, best = delays
    got = S.delay_search(spark, SF).collect()
    assert len(got) == len(found) == 1280
    for r in got:
        key = (tuple(r[f"{c}_delay"] for c in S.DELAYED), r["ridge"])
        assert np.isclose(r["rmse"], found[key], rtol=1e-7) and r["best"] == (key == best)


def test_ar_order_grid_and_final_model(spark, rows, delays):
    chosen = delays[1][0]
    found = {(order, ridge): e for order in (3, 6, 9, 12) for ridge, e in searched(rows, chosen, order)}
    got = {(r["ar_order"], r["ridge"]): (r["rmse"], r["best"]) for r in S.ar_order_grid(spark, SF).collect()}
    assert got.keys() == found.keys() and len(got) == 20
    best = min((e, *k) for k, e in found.items())
    for k, e in found.items():
        assert np.isclose(got[k][0], e, rtol=1e-7) and got[k][1] == ((e, *k) == best)
    x, actual, t = delay_design(rows, chosen, best[1]), rows["ntu"].to_numpy(), rows["t_idx"].to_numpy()
    whole = ~np.isnan(x).any(axis=1) & ~np.isnan(actual)
    last = model(x[whole & (t < 240)], np.log1p(actual[whole & (t < 240)]), best[2])
    terms = S.arx_parameters(spark, SF).collect()
    assert [r["term"] for r in terms] == ["intercept", *S._terms(chosen, best[1])] and np.allclose([r["coefficient"] for r in terms], last.beta, atol=1e-7)
    made = {r["t_idx"]: r["made"] for r in S.arx_external(spark, SF).collect()}
    assert made.keys() == set(t[whole & (t >= 240)]) and np.allclose([made[k] for k in t[whole & (t >= 240)]], back(last(x[whole & (t >= 240)])))


def test_factor_ranking(spark, rows, factor):
    x, y, actual, t, _, ridge = factor
    got = {r["factor"]: r for r in S.factor_ranking(spark, SF).collect()}
    known = rows[rows["ntu"].notna()]
    models = [(a, model(x[t < a], y[t < a], ridge, True)) for a, _ in (*S.FOLDS, (240, None))]
    block = lambda k: np.int64(np.uint64(xxhash.xxh64_intdigest(int(k).to_bytes(8, "little"), 42)).astype(np.int64))
    late = rows[rows["t_idx"] >= 240]
    full = [k for k, n in late.groupby(late["t_idx"] // 12).size().items() if n == 12]
    source = dict(zip(full, sorted(full, key=lambda k: (block(k), k))))
    test = late[(late["t_idx"] // 12).isin(full)]
    moved = test["t_idx"].map(lambda i: source[i // 12] * 12 + i % 12)
    told = test["ntu"].notna().to_numpy()
    importance = {}
    for c in S.SERIES:
        v, w = test[S.FEATURES].copy(), rows.set_index("t_idx").loc[moved, S.FACTORS[c]].to_numpy()
        base = rmse(test["ntu"].to_numpy()[told], back(models[-1][1](v.to_numpy(float)[told])))
        v[S.FACTORS[c]] = w
        importance[c] = rmse(test["ntu"].to_numpy()[told], back(models[-1][1](v.to_numpy(float)[told]))) - base
        signs = []
        for a, m in models:
            early, ends = known[known["t_idx"] < a], []
            for q in (0.75, 0.25):
                at = np.array(early[S.FEATURES].median().to_numpy(float))
                value = early[c].quantile(q)
                at[[S.FEATURES.index(f) for f in S.FACTORS[c]]] = np.log1p(value) if c in ("filt", "rw") else value
                ends.append(np.expm1(m(at[None])[0]))
            own = early[early[c].notna()]
            signs.append((np.sign(ends[0] - ends[1]), np.sign(own[c].rank().corr(own["ntu"].rank()))))
        r = got[c]
        agreement = np.mean([a == b != 0 for a, b in signs[:-1]])
        assert np.isclose(r["effect"], ends[0] - ends[1], rtol=1e-6) and np.isclose(r["rho"], own[c].rank().corr(own["ntu"].rank()))
        assert r["fold_signs"] == ",".join(str(int(a)) for a, _ in signs[:-1]) and np.isclose(r["agreement"], agreement) and np.isclose(r["importance"], importance[c], rtol=1e-6)
    for rank, c in enumerate(sorted(importance, key=lambda c: (-importance[c], c)), 1):
        assert got[c]["importance_rank"] == rank and got[c]["selected"] == (importance[c] > 0 and got[c]["agreement"] >= 0.75)


def test_evaluation_and_forecasts(spark, rows, factor):
    x, y, actual, t, _, ridge = factor
    got = {r["model"]: r for r in S.factor_evaluation(spark, SF).collect()}
    last, late = model(x[t < 240], y[t < 240], ridge, True), t >= 240
    e = back(last(x[late])) - actual[late]
    r2 = 1 - (e**2).sum() / ((actual[late] - actual[late].mean()) ** 2).sum()
    shifted = rows["ntu"].shift(12)
    both = (rows["t_idx"] >= 240) & rows["ntu"].notna() & shifted.notna()
    base = rmse(rows["ntu"][both], shifted[both])
    h = got["huber ridge"]
    assert np.allclose([h["rmse"], h["mae"], h["r2"]], [np.sqrt((e**2).mean()), np.abs(e).mean(), r2]) and h["n"] == late.sum() and h["passes"] == (r2 >= 0 and h["rmse"] < base)
    assert np.isclose(got["day before"]["rmse"], base) and got["day before"]["passes"] is False and got["cosine ridge"]["n"] == late.sum()
    pooled = np.concatenate([y[(t >= a) & (t < b)] - model(x[t < a], y[t < a], ridge, True)(x[(t >= a) & (t < b)]) for a, b in S.FOLDS])
    low, high = np.quantile(pooled, [0.025, 0.975])
    told = S.factor_forecasts(spark, SF).toPandas().sort_values("t_idx")
    at = rows.set_index("t_idx").loc[told["t_idx"], S.FEATURES].to_numpy(float)
    assert len(told) == 36 and np.allclose(told[["made", "low", "high"]], np.column_stack([back(last(at)), back(last(at) + low), back(last(at) + high)]))


def test_short_choices(spark, rows, factor):
    x, y, actual, t, *_ = factor
    a, b = S.SHORT
    train, valid = t < a, (t >= a) & (t < b)
    best = min((rmse(actual[valid], back(model(x[train], y[train], r, True)(x[valid]))), r) for r in S.RIDGES)
    found = []
    for d in product(range(4), repeat=4):
        v, z, at = delay_design(rows, d, 3), rows["ntu"].to_numpy(), rows["t_idx"].to_numpy()
        whole = ~np.isnan(v).any(axis=1) & ~np.isnan(z)
        one, two = whole & (at < a), whole & (at >= a) & (at < b)
        if one.sum() >= S.LEAST_TRAIN and two.sum() >= S.LEAST_JUDGED:
            found += [(rmse(z[two], back(model(v[one], np.log1p(z[one]), r)(v[two]))), sum(d), d, r) for r in S.RIDGES]
    got = {r["question"]: r for r in S.short_choices(spark, SF).collect()}
    assert np.isclose(got["factors"]["rmse"], best[0]) and got["factors"]["ridge"] == best[1]
    assert np.isclose(got["delays"]["rmse"], min(found)[0]) and got["delays"]["delays"] == ",".join(map(str, min(found)[2])) and got["delays"]["ridge"] == min(found)[3]


def test_factor_intervals(spark, rows):
    got = {r["factor"]: r for r in S.factor_intervals(spark, SF).collect()}
    early = rows[rows["t_idx"] < 240]
    for at, c in enumerate(S.SERIES):
        own = early[early[c].notna() & early["ntu"].notna()][[c, "ntu"]].reset_index(drop=True)
        rng, blocks, found = np.random.default_rng(S.SEED + at), len(own) // 12, []
        for _ in range(200):
            copied = own.iloc[np.concatenate([np.arange(12 * b, 12 * b + 12) for b in rng.integers(0, blocks, blocks)])]
            found.append(copied[c].rank().corr(copied["ntu"].rank()))
        assert np.allclose([got[c]["rho"], got[c]["low"], got[c]["high"]], [own[c].rank().corr(own["ntu"].rank()), *np.quantile(found, [0.025, 0.975])]) and got[c]["blocks"] == blocks


@pytest.mark.parametrize("most", [16, 4096])
def test_exact_quantiles(spark, most):
    rng = np.random.default_rng(0)
    x = np.column_stack([rng.normal(0, 1, 3000), np.round(rng.normal(0, 1, 3000), 1), np.zeros(3000), rng.integers(-1, 2, 3000) * 1e-300, np.full(3000, np.nan)])
    x[::7, 0] = np.nan
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{k} double" for k in range(5))).repartition(5)
    each = lambda m: ((k, m[:, k]) for k in range(5))
    got = passes.quantiles(df, [F.col(f"c{k}") for k in range(5)], each, (0.005, 0.5, 0.995), most)
    assert np.isnan(got[4]).all()
    for k in range(4):
        assert np.allclose(got[k], np.nanpercentile(x[:, k], [0.5, 50, 99.5]), rtol=1e-14, atol=0)
    for k, (mid, away) in passes.medians_and_spreads(df, [F.col(f"c{k}") for k in range(4)], lambda m: ((k, m[:, k]) for k in range(4)), most).items():
        v = x[:, k][~np.isnan(x[:, k])]
        assert mid == np.median(v) and away == np.median(np.abs(v - mid))
    assert passes.quantiles(df.where("false"), [F.col("c0")], each, (0.5,), most) == {}
