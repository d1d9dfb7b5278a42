"""Queries of the factor model and of the grid searches; a search is a few passes over the staged rows, whatever the grid.

Models learn the logarithm of the target, and are chosen by the error of the target itself.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.calendar import regular_slots
from oriel.operators.factors import block_intervals, factor_table, parameter_table, partial_curves
from oriel.operators.grids import Grid, Score, Share, cosine_features, mean_errors, median_spread, parts, sampled
from oriel.operators.local_fit import Fit
from oriel.operators.passes import quantiles, sum_arrays
from oriel.operators.regression import Ridge
from oriel.session import stage
from oriel.sources import read_table

RIDGES = (0.01, 0.1, 1.0, 10.0, 100.0)
SEED = 20260724
#: Lags of the factor model, its series, those of them that enter as logarithms, and slots before which it trains.
LAGS, SERIES, SKEWED, TRAIN_BEFORE = (0, 1, 2, 3, 6), ("filt", "rw", "ph", "alum", "flow"), ("filt", "rw"), 240
FACTORS = {c: [f"{c}_lag{k}" for k in LAGS] for c in SERIES}
CYCLES = ["hour_sin", "hour_cos", "year_sin", "year_cos"]
FEATURES = [f for fs in FACTORS.values() for f in fs] + CYCLES
#: Validated slots of each fold; all slots before one train. What comes after the last is the external test.
FOLDS = ((120, 150), (150, 180), (180, 210), (210, 240))
FINAL = len(FOLDS) + 1
DELAYED, STEPS, ORDERS = ("rw", "ph", "alum", "flow"), 4, (3, 6, 9, 12)
WIDTHS = (0.5, 1.0, 2.0)
#: Days for which the factor model's forecasts are told, counted from the first slot.
DAYS = (22, 25, 28)


def cell() -> Column:
    """Of a slot: 0 for what every fold trains on, k for fold k, FINAL after the last."""
    out = F.when(F.col("t_idx") < FOLDS[0][0], 0)
    for k, (_, end) in enumerate(FOLDS):
        out = out.when(F.col("t_idx") < end, k + 1)
    return out.otherwise(FINAL)


def designed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots with the lags of all series (logarithms of the skewed) over one window, cycles of day and year, and the logarithm of the target."""
    by = Window.partitionBy("series_id").orderBy("t_idx")
    value = {c: F.log1p(c) if c in SKEWED else F.col(c) for c in SERIES}
    lags = {f"{c}_lag{k}": F.lag(value[c], k).over(by) if k else value[c] for c in SERIES for k in sorted({*LAGS, *range(STEPS)})}
    own = {f"y_lag{k}": F.lag(F.log1p("ntu"), k).over(by) for k in range(1, max(ORDERS) + 1)}
    hour, day = (F.hour("ts") + F.minute("ts") / 60) * (2 * np.pi / 24), F.dayofyear("ts") * (2 * np.pi / 365.25)
    cycles = dict(zip(CYCLES, (F.sin(hour), F.cos(hour), F.sin(day), F.cos(day)), strict=True))
    return regular_slots(read_table(spark, sf_dir, "events")).withColumns(lags | own | cycles | {"y": F.log1p("ntu"), "day_before": F.lag("ntu", 12).over(by)})


def _factor_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    rows = stage(designed(spark, sf_dir), "design")
    return rows, Grid(rows, cell(), F.col("y"), F.col("ntu"), [F.col(c) for c in [*FEATURES, *SERIES]])


def _plain(x: np.ndarray) -> np.ndarray:
    return x[:, : len(FEATURES)]


PLAIN = [Share(k, _plain) for k in range(1, FINAL + 1)]


def _factor_models(grid: Grid) -> tuple[int, dict[int, Fit], dict[tuple[int, int], Score], list[tuple[float, float]]]:
    """The chosen ridge's number, the models with it by share (folds, then the model itself), all scores, and (error, ridge) of the search."""
    models = grid.fit(PLAIN, RIDGES, robust=True)
    scores = grid.scores(PLAIN, models)
    found = [(float(np.mean(e)), ridge) for r, ridge in enumerate(RIDGES) if (e := [scores[s, r].rmse for s in range(len(FOLDS)) if (s, r) in scores])]
    best = RIDGES.index(min(found)[1]) if found else 0
    return best, {s: models[s, best] for s in range(FINAL) if (s, best) in models}, scores, found


def ridge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean validation error of the robust factor model by ridge, over four folds; of equal errors the smaller ridge is best."""
    _, grid = _factor_grid(spark, sf_dir)
    *_, found = _factor_models(grid)
    return spark.createDataFrame([(r, e, (e, r) == min(found)) for e, r in found], "ridge double, rmse double, best boolean")


def factor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance, effect, direction and its stability over four folds, and which factors are selected, with the ridge of the search."""
    rows, grid = _factor_grid(spark, sf_dir)
    _, models, _, _ = _factor_models(grid)
    folds = [F.col("t_idx") < start for start, _ in FOLDS] + [F.col("t_idx") < TRAIN_BEFORE]
    return factor_table(rows, grid, PLAIN, models, FACTORS, FEATURES, "ntu", folds, F.col("t_idx") >= TRAIN_BEFORE, SKEWED)


def factor_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of each factor with the target before the external test, with its range over 200 draws of blocks of twelve rows."""
    rows = designed(spark, sf_dir).where(F.col("t_idx") < TRAIN_BEFORE)
    return block_intervals(rows, list(SERIES), "ntu", SEED)


def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight factors that matter most, the least of them first, and whether they are selected."""
    return factor_ranking(spark, sf_dir).where("importance_rank <= 8").orderBy(F.desc("importance_rank")).select("factor", "importance", "importance_rank", "selected")


def _parameters(spark: SparkSession, model: Fit) -> DataFrame:
    return parameter_table(spark, Ridge.of(FEATURES, model), FACTORS | {"cycle": CYCLES})


def factor_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor model, with the ridge of the search, as a table of parameters."""
    _, grid = _factor_grid(spark, sf_dir)
    return _parameters(spark, _factor_models(grid)[1][FINAL - 1])


def partial_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 points of each factor's partial curve, from its 5 to its 95 percentile."""
    _, grid = _factor_grid(spark, sf_dir)
    model = _factor_models(grid)[1][FINAL - 1]
    each = lambda x: ((j, x[x[:, 0] < FINAL, 3 + len(FEATURES) + j]) for j in range(len(SERIES)))
    spans = quantiles(grid.rows, grid.columns, each, (0.05, 0.95))
    ends = spark.createDataFrame([(c, *spans[j], c in SKEWED) for j, c in enumerate(SERIES)], "factor string, first double, last double, logs boolean")
    return partial_curves(_parameters(spark, model), ends)


def _cosine_shares(grid: Grid, folds: list[int]) -> list[tuple[float, Share]]:
    """Shares of every width, in order of folds: each draws its features from its fold's own sample, bounds and seed."""
    plain = [Share(k, _plain) for k in folds]
    fits = grid.fit(plain, (1.0,))
    samples = sampled(grid, folds, F.col("t_idx"), SEED)
    shares = []
    for s, k in enumerate(folds):
        if (s, 0) in fits:
            fit = fits[s, 0]
            spread = median_spread(fit.standard(samples[k][:, : len(FEATURES)]))
            shares += [(w, Share(k, _of_plain(cosine_features(fit, spread * w, SEED + k - 1 if k < FINAL else SEED)))) for w in WIDTHS]
    return shares


def _of_plain(make: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: make(_plain(x))


def _cosine_found(grid: Grid, folds: list[int]) -> list[tuple[float, float, float]]:
    """(error, ridge, width) of the search."""
    return [(e, ridge, width) for (width, ridge), e in mean_errors(_cosine_shares(grid, folds), RIDGES, grid).items()]


def cosine_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean validation error of 256 random cosine features by width (times the median heuristic) and ridge, over four folds.

    Every fold has bounds, standardisation, sample and draw of its own. Of equal errors the smaller ridge, then the smaller width is best.
    """
    _, grid = _factor_grid(spark, sf_dir)
    found = _cosine_found(grid, list(range(1, FINAL)))
    return spark.createDataFrame([(w, r, e, (e, r, w) == min(found)) for e, r, w in found], "width double, ridge double, rmse double, best boolean")


def factor_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models on the external test beside the value of the day before, and whether they pass: r2 of 0 or more, and an error under the day before's."""
    rows, grid = _factor_grid(spark, sf_dir)
    best, _, scores, _ = _factor_models(grid)
    shares = _cosine_shares(grid, list(range(1, FINAL + 1)))
    models = grid.fit([s for _, s in shares], RIDGES)
    judged = grid.scores([s for _, s in shares], models)
    errors: dict[tuple[float, int], list[float]] = {}
    for (s, r), score in judged.items():
        if shares[s][1].fold < FINAL:
            errors.setdefault((shares[s][0], r), []).append(score.rmse)
    width, r = min(errors, key=lambda k: (float(np.mean(errors[k])), k[1], k[0]))
    cosine = next(score for (s, k), score in judged.items() if shares[s][1].fold == FINAL and shares[s][0] == width and k == r)
    off = F.col("ntu") - F.col("day_before")
    about = F.sum(F.col("ntu") * F.col("ntu")) - F.sum("ntu") * F.sum("ntu") / F.count("*")
    b = rows.where((cell() == FINAL) & off.isNotNull()).agg(F.count("*"), F.sqrt(F.avg(off * off)), F.avg(F.abs(off)), 1 - F.sum(off * off) / F.nullif(about, F.lit(0.0))).first()
    table = [("huber ridge", scores[FINAL - 1, best]), ("cosine ridge", cosine), ("day before", Score(*b))]
    gate = lambda m: None if m.r2 is None or b[1] is None else m.r2 >= 0 and m.rmse < b[1]
    return spark.createDataFrame([(name, m.n, m.rmse, m.mae, m.r2, gate(m)) for name, m in table], "model string, n long, rmse double, mae double, r2 double, passes boolean")


def factor_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the factor model for all slots of three days, with the 95 % range of the pooled residuals of the four folds."""
    rows, grid = _factor_grid(spark, sf_dir)
    _, models, _, _ = _factor_models(grid)
    each = lambda x: ((0, y - models[s].predict(f)) for s, share, f, y, _ in parts(x, PLAIN[:-1], judged=True) if s in models and len(f))
    low, high = quantiles(grid.rows, grid.columns, each, (0.025, 0.975)).get(0, [float("nan")] * 2)
    log, back = Ridge.of(FEATURES, models[FINAL - 1]).predict(), lambda x: F.greatest(F.lit(0.0), F.expm1(x))
    days = F.floor((F.col("t_idx") + 3) / 12).isin(*DAYS)
    return rows.where(days).select("series_id", "t_idx", "op_day", back(log).alias("made"), back(log + F.lit(low)).alias("low"), back(log + F.lit(high)).alias("high"))


#: Columns of the delay searches: factors at delays, then own lags; and the terms of a model in their order.
DELAY_COLUMNS = [f"{c}_lag{d}" for c in DELAYED for d in range(STEPS)] + [f"y_lag{k}" for k in range(1, max(ORDERS) + 1)]


def _terms(delays: tuple[int, ...], order: int) -> list[str]:
    named = dict(zip(DELAYED, delays, strict=True))
    plain = [f"{c}_lag{d}" for c, d in named.items()]
    return [f"y_lag{k}" for k in range(1, order + 1)] + plain + [f"{p}_squared" for p in plain] + [f"{c}_lag{named[c]}_alum_lag{named['alum']}" for c in ("rw", "ph")]


def _delay_terms(delays: tuple[int, ...], order: int) -> Callable[[np.ndarray], np.ndarray]:
    """_terms() as a matrix of DELAY_COLUMNS."""
    at = [STEPS * k + d for k, d in enumerate(delays)]
    own = [STEPS * len(DELAYED) + k for k in range(order)]

    def make(x: np.ndarray) -> np.ndarray:
        v = x[:, at]
        return np.column_stack([x[:, own], v, v**2, v[:, 0] * v[:, 2], v[:, 1] * v[:, 2]])

    return make


def _delay_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    rows = stage(designed(spark, sf_dir), "design")
    return rows, Grid(rows, cell(), F.col("y"), F.col("ntu"), [F.col(c) for c in DELAY_COLUMNS], told_apart=256)


def _delays_found(grid: Grid) -> list[tuple]:
    """(delays, ridge, error) of the search over all delays, with own lags 1 to 3."""
    makes = {d: _delay_terms(d, ORDERS[0]) for d in product(range(STEPS), repeat=len(DELAYED))}
    shares = [(d, Share(k, make, filled=False)) for d, make in makes.items() for k in range(1, FINAL)]
    return [(d, ridge, e) for (d, ridge), e in mean_errors(shares, RIDGES, grid).items()]


def _best_delays(found: list[tuple]) -> tuple:
    return min(found, key=lambda r: (r[2], sum(r[0]), r[0], r[1]))


def delay_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean validation error of all 256 delays of four factors by 5 ridges over four folds, own lags 1 to 3: 5,120 fits side by side.

    Each delay is judged on the rows that are complete for it. Of equal errors the least sum of
    delays, then the least delays, then the least ridge is best.
    """
    found = _delays_found(_delay_grid(spark, sf_dir)[1])
    best = _best_delays(found) if found else None
    return spark.createDataFrame([(*d, ridge, e, (d, ridge, e) == best) for d, ridge, e in found], ", ".join(f"{c}_delay int" for c in DELAYED) + ", ridge double, rmse double, best boolean")


def delay_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least error of the delay search by the delays of raw turbidity and dose, as a 4 by 4 table."""
    return delay_search(spark, sf_dir).groupBy("rw_delay").pivot("alum_delay", [0, 1, 2, 3]).agg(F.min("rmse"))


def _orders_found(grid: Grid) -> tuple[tuple[int, ...], list[tuple[float, int, float]]]:
    """The chosen delays, and (error, order, ridge) of models with them and more own lags, each on its own complete rows."""
    delays = _best_delays(_delays_found(grid))[0]
    makes = {order: _delay_terms(delays, order) for order in ORDERS}
    shares = [(order, Share(k, make, filled=False)) for order, make in makes.items() for k in range(1, FINAL)]
    return delays, [(e, order, ridge) for (order, ridge), e in mean_errors(shares, RIDGES, grid).items()]


def ar_order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean validation error by number of own lags and ridge, with the chosen delays; of equal errors the least order, then the least ridge is best."""
    _, found = _orders_found(_delay_grid(spark, sf_dir)[1])
    return spark.createDataFrame([(o, r, e, (e, o, r) == min(found)) for e, o, r in found], "ar_order int, ridge double, rmse double, best boolean")


def _arx(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, ...], int, float, Fit]:
    rows, grid = _delay_grid(spark, sf_dir)
    delays, found = _orders_found(grid)
    _, order, ridge = min(found)
    return rows, delays, order, ridge, grid.fit([Share(FINAL, _delay_terms(delays, order), filled=False)], (ridge,))[0, 0]


def arx_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the final model with own lags and chosen delays, and their directions."""
    _, delays, order, ridge, fit = _arx(spark, sf_dir)
    rows = [("intercept", fit.intercept), *zip(_terms(delays, order), map(float, fit.weights), strict=True)]
    return spark.createDataFrame([(t, c, "positive" if c >= 0 else "negative", order, ridge) for t, c in rows], "term string, coefficient double, direction string, ar_order int, ridge double")


def arx_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the final model for later slots beside what was measured, as a series."""
    rows, delays, order, _, fit = _arx(spark, sf_dir)
    named = dict(zip(DELAYED, [f"{c}_lag{d}" for c, d in zip(DELAYED, delays, strict=True)], strict=True))
    terms = {f"{p}_squared": F.col(p) * F.col(p) for p in named.values()} | {f"{named[c]}_{named['alum']}": F.col(named[c]) * F.col(named["alum"]) for c in ("rw", "ph")}
    names = _terms(delays, order)
    rows = rows.withColumns(terms).where((cell() == FINAL) & F.col("y").isNotNull()).dropna(subset=names)
    return rows.select("series_id", "t_idx", F.col("ntu").alias("actual"), F.greatest(F.lit(0.0), F.expm1(Ridge.of(names, fit).predict())).alias("made"))


def identifiable_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each factor whether its chosen delay lies within two steps of the peak of the cross-correlation of differences, and its values aren't degenerate (one value in nine rows of ten)."""
    delays = _best_delays(_delays_found(_delay_grid(spark, sf_dir)[1]))[0]
    by = Window.partitionBy("series_id").orderBy("t_idx")
    slots = regular_slots(read_table(spark, sf_dir, "events"))
    moved = slots.withColumn("dy", F.log1p("ntu") - F.lag(F.log1p("ntu"), 1).over(by))
    moved = moved.withColumns({f"d_{c}": F.col(c) - F.lag(c, 1).over(by) for c in DELAYED})
    peaks = moved.withColumns({f"{c}_{k}": F.lag(f"d_{c}", k).over(by) for c in DELAYED for k in range(7)}).agg(*[F.corr(f"{c}_{k}", "dy").alias(f"{c}_{k}") for c in DELAYED for k in range(7)]).first()
    values = slots.where(F.col("t_idx") < TRAIN_BEFORE).select(F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("x")) for c in DELAYED]))).where("x is not null")
    share = {r["factor"]: (r["share"], r["n"]) for r in values.groupBy("factor", "x").agg(F.count("*").alias("c")).groupBy("factor").agg((F.max("c") / F.sum("c")).alias("share"), F.count("*").alias("n")).collect()}
    out = []
    for c, d in zip(DELAYED, delays, strict=True):
        found = [abs(peaks[f"{c}_{k}"] or 0.0) for k in range(7)]
        peak, (most, distinct) = int(np.argmax(found)), share.get(c, (1.0, 0))
        degenerate = most >= 0.9 or distinct <= 1
        out.append((c, d, peak, float(found[peak]), float(most), degenerate, abs(peak - d) <= 2 and not degenerate))
    return spark.createDataFrame(out, "factor string, delay int, peak int, correlation double, mode_share double, degenerate boolean, identifiable boolean")


#: The single fold of the short choices: slots before it train; and rows that a delay needs on either side.
SHORT, LEAST_TRAIN, LEAST_JUDGED = (210, 240), 100, 20


def _short_cell() -> Column:
    return F.when(F.col("t_idx") < SHORT[0], 0).when(F.col("t_idx") < SHORT[1], 1)


def short_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a single fold would choose: the factor model's ridge, and delays and ridge of the model with own lags 1 to 3; they may differ from the searches' choices.

    Delays with too few complete rows to train or judge by don't take part.
    """
    rows = stage(designed(spark, sf_dir), "design")
    grid = Grid(rows, _short_cell(), F.col("y"), F.col("ntu"), [F.col(c) for c in [*FEATURES, *SERIES]])
    plain = [Share(1, _plain)]
    judged = grid.scores(plain, grid.fit(plain, RIDGES, robust=True))
    found = [("factors", *min((s.rmse, RIDGES[r], "", s.mae, s.r2) for (_, r), s in judged.items()))] if judged else []
    grid = Grid(rows, _short_cell(), F.col("y"), F.col("ntu"), [F.col(c) for c in DELAY_COLUMNS], told_apart=256)
    delays = list(product(range(STEPS), repeat=len(DELAYED)))
    shares = [Share(1, _delay_terms(d, ORDERS[0]), filled=False) for d in delays]
    trained = sum_arrays(grid.rows, grid.columns, lambda x: ((s, np.array([len(f)])) for s, _, f, _, _ in parts(x, shares)))
    judged = grid.scores(shares, grid.fit(shares, RIDGES))
    fine = [(s.rmse, sum(delays[k]), delays[k], RIDGES[r], s.mae, s.r2) for (k, r), s in judged.items() if trained[k][0] >= LEAST_TRAIN and s.n >= LEAST_JUDGED]
    if fine:
        rmse, _, d, ridge, mae, r2 = min(fine)
        found.append(("delays", rmse, ridge, ",".join(map(str, d)), mae, r2))
    return spark.createDataFrame([(q, d, ridge, e, mae, r2) for q, e, ridge, d, mae, r2 in found], "question string, delays string, ridge double, rmse double, mae double, r2 double")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (ridge_search, factor_ranking, factor_intervals, top_factors, factor_parameters, partial_effects, cosine_grid, factor_evaluation, factor_forecasts, delay_search, delay_matrix, ar_order_grid, arx_parameters, arx_external, identifiable_delays, short_choices)}
