"""Residual models by horizon: samples, choice of the ridge, joint errors, backtest, filled gaps and simulated paths.

Models are fitted series by series and horizon by horizon, each group inside one task: a group is
the slots of one series, some thousands, however many series there are. Everything between the
fits (samples, predictions, metrics, quantiles) are Spark columns.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.local_fit import Fit, fit
from oriel.operators.state import HORIZONS, ROLES, STATE_NAMES

RIDGES = (0.01, 0.1, 1.0, 10.0, 100.0)
#: Blocks of errors that paths take, and how many joint error vectors a series needs at least.
BLOCK, LEAST_VECTORS = 12, 100


def state_array() -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in STATE_NAMES])


def horizon_origins(states: DataFrame, target: str = "ntu", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Rows (series_id, t_idx, horizon, at, x, base, actual, persisted): one for each origin with known residuals and each horizon, whether or not its target is known.

    at: the target's t_idx, which may lie beyond the series; x: the state vector; base: the
    logarithm (of one more) of the physical forecast; actual: the target, null if it isn't
    known; persisted: the origin's own value. A model's target is log1p(actual) - base.
    """
    by = Window.partitionBy("series_id").orderBy("t_idx")
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(target, h).over(by).alias("actual"), F.log1p(f"ahead{h}").alias("base")) for h in horizons])
    rows = states.select("series_id", "t_idx", "available", state_array().alias("x"), F.col(target).alias("persisted"), ahead.alias("_ahead"))
    rows = rows.where("available").select("series_id", "t_idx", "x", "persisted", F.inline("_ahead"))
    return rows.where("base is not null").withColumn("at", F.col("t_idx") + F.col("horizon"))


def horizon_samples(states: DataFrame, target: str = "ntu", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """The rows of horizon_origins() whose target is known: what models learn from and are judged by."""
    return horizon_origins(states, target, horizons).where("actual is not null")


def _choose(folds: tuple[tuple[int, int], ...], ridges: tuple[float, ...], ends: dict[str, int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t_idx")
        x, base, actual, at = np.stack(rows["x"]).astype(float), rows["base"].to_numpy(), rows["actual"].to_numpy(), rows["at"].to_numpy()
        y, scores = np.log1p(actual) - base, []
        for ridge in ridges:
            errors = []
            for start, end in folds:
                train, valid = at < start, (at >= start) & (at < end)
                if train.sum() > 1 and valid.any():
                    made = np.maximum(0.0, np.expm1(base[valid] + fit(x[train], y[train], ridge).predict(x[valid])))
                    errors.append(np.sqrt(np.mean((made - actual[valid]) ** 2)))
            scores.append((float(np.mean(errors)) if errors else np.inf, ridge))
        rmse, ridge = min(scores)
        first, out = rows.iloc[0], []
        for model, end in ends.items():
            if (at < end).sum() > 1:
                out.append((first["series_id"], int(first["horizon"]), model, ridge, rmse, fit(x[at < end], y[at < end], ridge).numbers().tolist()))
        return pd.DataFrame(out, columns=["series_id", "horizon", "model", "ridge", "rmse", "numbers"])

    return chosen


def horizon_models(samples: DataFrame, folds: tuple[tuple[int, int], ...], ends: dict[str, int], ridges: tuple[float, ...] = RIDGES) -> DataFrame:
    """Rows (series_id, horizon, model, ridge, rmse, numbers): Huber ridges by horizon, with the ridge of the least mean error over the folds.

    folds: (start, end) of what is validated, by the target's t_idx; all before it trains. ends:
    name of a model and where its training ends. Ties take the smaller ridge. numbers: see Fit.
    """
    return samples.groupBy("series_id", "horizon").applyInPandas(_choose(folds, ridges, ends), "series_id string, horizon int, model string, ridge double, rmse double, numbers array<double>")


def predicted(x: str, numbers: str, width: int = len(STATE_NAMES)) -> Column:
    """A model's prediction from a state vector, as whole-stage code over the two arrays."""
    number = lambda part: f"{numbers}[i + {part * width}]"
    value = f"least(greatest(nanvl({x}[i], {number(1)}), {number(0)}), {number(2)})"
    return F.expr(f"aggregate(sequence(0, {width - 1}), {numbers}[{6 * width}], (s, i) -> s + ({value} - {number(3)}) / {number(4)} * {number(5)})")


def with_prediction(samples: DataFrame, models: DataFrame, model: str) -> DataFrame:
    """samples with log_made, the logarithm (of one more) of the forecast of that model; samples without a model go."""
    own = models.where(F.col("model") == model).select("series_id", "horizon", "numbers")
    return samples.join(own, ["series_id", "horizon"]).withColumn("log_made", F.col("base") + predicted("x", "numbers")).drop("numbers")


def joint_errors(samples: DataFrame, models: DataFrame, start: int, end: int, model: str = "interim", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Rows (series_id, t_idx, errors): the errors in logarithms of all horizons from one origin, for origins from start on whose targets lie before end and are all known."""
    rows = with_prediction(samples.where((F.col("t_idx") >= start) & (F.col("t_idx") + max(horizons) < end)), models, model)
    one = [F.max(F.when(F.col("horizon") == h, F.log1p("actual") - F.col("log_made"))) for h in horizons]
    found = rows.groupBy("series_id", "t_idx").agg(F.count("*").alias("n"), F.array(*one).alias("errors"))
    return found.where(F.col("n") == len(horizons)).drop("n")


def gate_vectors(errors: DataFrame, least: int = LEAST_VECTORS) -> DataFrame:
    """errors of the series with enough vectors; raises where a series has fewer."""
    by = Window.partitionBy("series_id")
    text = F.concat(F.lit("too few joint error vectors for series "), F.col("series_id"))
    return errors.withColumn("_n", F.count("*").over(by)).withColumn("errors", F.when(F.col("_n") >= least, F.col("errors")).otherwise(F.raise_error(text).cast("array<double>"))).drop("_n")


def backtest(samples: DataFrame, models: DataFrame, errors: DataFrame, start: int, model: str = "final") -> DataFrame:
    """Rows (series_id, horizon_hours, model, rmse, mae, r2, coverage, n, beats_persistence) over targets from start on.

    The hybrid's interval adds the 2.5 and 97.5 percentiles of the joint errors; coverage and
    beats_persistence are null for the other models, r2 for a constant target.
    """
    width = F.explode(F.transform("errors", lambda e, i: F.struct((i + 1).alias("horizon"), e.alias("e"))))
    spread = errors.select("series_id", width.alias("w")).groupBy("series_id", F.col("w.horizon").alias("horizon")).agg(F.percentile("w.e", F.array(F.lit(0.025), F.lit(0.975))).alias("spread"))
    back = lambda x: F.greatest(F.lit(0.0), F.expm1(x))
    rows = with_prediction(samples.where((F.col("t_idx") >= start) & F.col("persisted").isNotNull()), models, model).join(spread, ["series_id", "horizon"])
    inside = F.col("actual").between(back(F.col("log_made") + F.col("spread")[0]), back(F.col("log_made") + F.col("spread")[1]))
    kinds = F.array(*[F.struct(F.lit(k).alias("model"), x.alias("made")) for k, x in (("hybrid", back(F.col("log_made"))), ("persistence", F.col("persisted")), ("physical", F.expm1("base")))])
    each = rows.withColumn("_in", inside.cast("double")).select("series_id", "horizon", "actual", "_in", F.inline(kinds))
    off = F.col("made") - F.col("actual")
    r2 = F.when(F.max("actual") > F.min("actual"), 1 - F.sum(off * off) / (F.var_pop("actual") * F.count("*")))
    scored = each.groupBy("series_id", "horizon", "model").agg(F.sqrt(F.avg(off * off)).alias("rmse"), F.avg(F.abs(off)).alias("mae"), r2.alias("r2"), F.when(F.col("model") == "hybrid", F.avg("_in")).alias("coverage"), F.count("*").alias("n"))
    rival = F.max(F.when(F.col("model") == "persistence", F.col("rmse"))).over(Window.partitionBy("series_id", "horizon"))
    return scored.withColumn("beats_persistence", F.when(F.col("model") == "hybrid", F.col("rmse") < rival)).withColumn("horizon_hours", 2 * F.col("horizon")).drop("horizon")


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("t_idx")
    model, state, out = None, None, []
    for r in rows.itertuples(index=False):
        x = np.array(r.x, float) if r.x is not None else None
        if state is None:
            state = x[:6].copy() if x is not None else np.full(6, np.nan)
        y = r.y
        if pd.isna(y) and x is not None and not pd.isna(r.base) and r.numbers is not None:
            model = model or Fit.of(r.numbers)
            x[:6] = state
            y = max(0.0, float(np.expm1(r.base + model.predict(x[None])[0])))
        state = np.r_[np.nan if pd.isna(y) else np.log1p(y) - r.log_physical, state[:5]]
        out.append((y, state[0]))
    return rows[["series_id", "t_idx"]].assign(filled=[y for y, _ in out], residual=[r for _, r in out])


def fill_gaps_by_model(states: DataFrame, models: DataFrame, target: str = "ntu", model: str = "final", free: tuple[int, int] | None = None) -> DataFrame:
    """Rows (series_id, t_idx, filled, residual): target, or where it is null the one-step forecast from the state filled so far; residual is that of filled.

    free: slots (first, after the last) that are forecast though they may be observed; what is
    observed there isn't read. The recursion needs the last six residuals: it starts anew where
    these are all observed, so a series falls into stretches that run side by side, of which the
    free slots are one with the six after them. Without a forecast a gap stays null.
    """
    by = Window.partitionBy("series_id").orderBy("t_idx")
    seen = F.col(target) if free is None else F.when((F.col("t_idx") < free[0]) | (F.col("t_idx") >= free[1]), F.col(target))
    known = F.count(F.when(seen.isNotNull(), F.col("physical"))).over(by.rowsBetween(-6, -1)) == 6
    rows = states.select("series_id", "t_idx", seen.alias("y"), F.log1p("physical").alias("log_physical"), F.lag(state_array(), 1).over(by).alias("x"), F.lag(F.log1p("ahead1"), 1).over(by).alias("base"), known.alias("_known"))
    rows = rows.withColumn("stretch", F.sum(F.col("_known").cast("long")).over(by)).drop("_known")
    own = models.where((F.col("model") == model) & (F.col("horizon") == 1)).select("series_id", "numbers")
    filled = rows.join(own, "series_id", "left").groupBy("series_id", "stretch").applyInPandas(_fill, "series_id string, t_idx long, filled double, residual double")
    return filled.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("filled", "residual")})


def with_filled(states: DataFrame, filled: DataFrame) -> DataFrame:
    """states with the residuals of fill_gaps_by_model(): their lags and what is available follow from these; and with the column filled."""
    by = Window.partitionBy("series_id").orderBy("t_idx")
    rows = states.drop("residual").join(filled.select("series_id", "t_idx", "filled", "residual"), ["series_id", "t_idx"])
    lags = {f"residual_lag{k}": F.lag("residual", k).over(by) if k else F.col("residual") for k in range(6)}
    return rows.withColumns(lags | {"available": F.count("residual").over(by.rowsBetween(-5, 0)) == 6})


def _simulate(start: int, paths: int, chunks: int, origins: frozenset[int]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        rows, chunk = rows.sort_values("t_idx"), int(rows["chunk"].iloc[0])
        pool = np.stack(side[side["kind"] == "error"].sort_values("place")["numbers"]).astype(float) if (side["kind"] == "error").any() else np.zeros((1, 6))
        models = {int(r.place): Fit.of(r.numbers) for r in side[side["kind"] == "model"].itertuples()}
        mine = np.arange(chunk, paths, chunks)
        times, xs, bases = rows["t_idx"].to_numpy(), [np.asarray(x, float) for x in rows["x"]], np.stack(rows["bases"]).astype(float)
        logs, state, out = rows["log_physical"].to_numpy(), None, []
        for at in range(len(rows)):
            x, simulated = np.repeat(xs[at][None], len(mine), axis=0), int(times[at]) >= start - 1
            if state is not None:
                x[:, :6] = state
            step = int(times[at]) - start + 6
            # Circular blocks of errors; where a block starts depends on the path and the block's number alone.
            first = (mine * 48271 + (step // BLOCK) * 69621 + 12345) * 16807 % 2147483647
            errors = pool[(first + step % BLOCK) % len(pool)]
            made = {h: np.maximum(0.0, np.expm1(bases[at, h - 1] + m.predict(x) + errors[:, h - 1])) for h, m in models.items() if (simulated if h == 1 else int(times[at]) in origins)}
            for h, values in made.items():
                out.append(pd.DataFrame({"path": mine, "t_idx": int(times[at]), "horizon": h, "y": values}))
            if simulated:
                if 1 not in made or at + 1 >= len(rows):
                    break
                state = np.column_stack([np.log1p(made[1]) - logs[at + 1], x[:, :5]])
        found = pd.concat(out) if out else pd.DataFrame({"path": [], "t_idx": [], "horizon": [], "y": []})
        return found.assign(series_id=rows["series_id"].iloc[0])

    return run


def simulate_paths(states: DataFrame, models: DataFrame, errors: DataFrame, start: int, end: int, paths: int = 500, origins: tuple[int, ...] = (), model: str = "final", chunks: int = 8) -> DataFrame:
    """Rows (series_id, path, t_idx, horizon, y): paths that go on from their own simulated residuals, from start to end.

    Horizon 1 is the path itself: y is its value one step after t_idx. From the origins, which may
    lie up to six slots before start, the other horizons are forecast directly from the path's
    state with the same errors. Paths are dealt over chunks, which run side by side. Before start
    the states' residuals count, so gaps among them are to be filled (with_filled()).
    """
    rows = states.where((F.col("t_idx") >= start - 6) & (F.col("t_idx") <= end)).select("series_id", "t_idx", state_array().alias("x"), F.array(*[F.log1p(f"ahead{h}") for h in HORIZONS]).alias("bases"), F.log1p("physical").alias("log_physical"))
    vectors = errors.select("series_id", F.lit("error").alias("kind"), F.col("t_idx").cast("long").alias("place"), F.col("errors").alias("numbers"))
    fits = models.where(F.col("model") == model).select("series_id", F.lit("model").alias("kind"), F.col("horizon").cast("long").alias("place"), "numbers")
    chunk = F.explode(F.array(*[F.lit(k) for k in range(chunks)])).alias("chunk")
    left, right = (df.select("*", chunk).groupBy("series_id", "chunk") for df in (rows, vectors.union(fits)))
    run = _simulate(start, paths, chunks, frozenset(origins))
    return left.cogroup(right).applyInPandas(lambda a, b: run(a, b)[["series_id", "path", "t_idx", "horizon", "y"]] if len(a) and len(b) else pd.DataFrame({"series_id": [], "path": [], "t_idx": [], "horizon": [], "y": []}), "series_id string, path long, t_idx long, horizon long, y double")


def fan(paths: DataFrame, origins: tuple[int, ...]) -> DataFrame:
    """Rows (series_id, t_idx, hours, interpolated, low, mid, high): quantiles of the paths 1 to 12 hours after each origin; odd hours lie midway in logarithms, path by path."""
    by = Window.partitionBy("series_id", "path", "t_idx").orderBy("horizon")
    start = paths.where("horizon = 1").select("series_id", "path", (F.col("t_idx") + 1).alias("t_idx"), F.lit(0).cast("long").alias("horizon"), "y")
    even = paths.unionByName(start).where(F.col("t_idx").isin(*origins))
    both = even.withColumn("_next", F.lead("y", 1).over(by)).withColumn("_gap", F.lead("horizon", 1).over(by) - F.col("horizon"))
    odd = both.where("_gap = 1").select("series_id", "t_idx", (2 * F.col("horizon") + 1).alias("hours"), F.lit(True).alias("interpolated"), F.expm1((F.log1p("y") + F.log1p("_next")) / 2).alias("y"))
    whole = both.where("horizon > 0").select("series_id", "t_idx", (2 * F.col("horizon")).alias("hours"), F.lit(False).alias("interpolated"), "y").unionByName(odd)
    q = whole.groupBy("series_id", "t_idx", "hours", "interpolated").agg(F.percentile("y", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    return q.select("series_id", "t_idx", "hours", "interpolated", *[F.col("q")[k].alias(c) for k, c in enumerate(("low", "mid", "high"))])


GRADES = ("SAFE", "LOW", "MEDIUM", "HIGH")


def path_grades(days: DataFrame, limit: float = 55.0) -> DataFrame:
    """Rows (series_id, op_day, safe, low, medium, high, modal, grade_low, grade_high) from rows (series_id, path, op_day, t_idx, y) of simulated paths.

    Each path's day is graded by its excess over the limit and its longest run above it; votes
    become probabilities. The modal grade takes the less severe of equals; the 95 % range are the
    nearest-rank quantiles of the grades' codes.
    """
    order = Window.partitionBy("series_id", "path", "op_day").orderBy("t_idx")
    above = days.withColumn("_above", (F.col("y") > limit).cast("int")).withColumn("_run", F.row_number().over(order) - F.sum("_above").over(order))
    runs = above.groupBy("series_id", "path", "op_day", "_run").agg(F.sum("_above").alias("length"), F.max("y").alias("most"))
    day = runs.groupBy("series_id", "path", "op_day").agg((2 * F.max("length")).alias("hours"), F.greatest(F.max("most") - limit, F.lit(0.0)).alias("amplitude"))
    code = F.when(F.col("amplitude") <= 0, 0).when((F.col("amplitude") <= 10) & (F.col("hours") <= 4), 1).when((F.col("amplitude") <= 20) & (F.col("hours") <= 8), 2).otherwise(3)
    votes = day.select("series_id", "op_day", code.alias("code")).groupBy("series_id", "op_day", "code").agg(F.count("*").alias("n"))
    by = Window.partitionBy("series_id", "op_day")
    ranked = votes.withColumn("total", F.sum("n").over(by)).withColumn("upto", F.sum("n").over(by.orderBy("code")))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(p * (F.col("total") - 1)), F.col("code")))
    name = lambda c: F.element_at(F.array(*[F.lit(g) for g in GRADES]), (c + 1).cast("int"))
    share = [F.coalesce(F.max(F.when(F.col("code") == k, F.col("n") / F.col("total"))), F.lit(0.0)).alias(g.lower()) for k, g in enumerate(GRADES)]
    return ranked.groupBy("series_id", "op_day").agg(*share, name(F.max_by("code", F.struct("n", -F.col("code")))).alias("modal"), name(at(0.025)).alias("grade_low"), name(at(0.975)).alias("grade_high"))


def scenario_forecasts(states: DataFrame, models: DataFrame, origins: tuple[int, ...], scenarios: tuple[tuple[str, str, float], ...], roles: dict[str, str] = ROLES, model: str = "final") -> DataFrame:
    """Rows (series_id, t_idx, horizon, scenario, base_value, scenario_value, delta, elasticity): for every origin, horizon and scenario one, whether or not a target is known.

    scenarios: name, role (rw or alum) and the share by which its value at the origin changes.
    Only the state vector changes; where the value isn't known nothing does. elasticity is null
    for a base of 0.
    """
    at = states.where(F.col("t_idx").isin(*origins))
    spots = {c: STATE_NAMES.index(c) for c in ("log_rw", "delta_log_rw", "alum")}
    changed = []
    for name, role, share in scenarios:
        value = F.col(roles[role]).cast("double") * (1 + share)
        new = {"alum": value} if role == "alum" else {"log_rw": F.log1p(value), "delta_log_rw": F.log1p(value) - F.col("log_rw_lag1")}
        x = F.array(*[F.coalesce(new.get(c, F.col(c)).cast("double"), F.lit(float("nan"))) if c in spots else state_array()[k] for k, c in enumerate(STATE_NAMES)])
        changed.append(F.struct(F.lit(name).alias("scenario"), F.lit(share).alias("share"), x.alias("changed")))
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.log1p(f"ahead{h}").alias("base")) for h in HORIZONS])
    rows = at.select("series_id", "t_idx", state_array().alias("x"), ahead.alias("ahead"), F.inline(F.array(*changed))).select("*", F.inline("ahead"))
    own = models.where(F.col("model") == model).select("series_id", "horizon", "numbers")
    made = lambda x: F.greatest(F.lit(0.0), F.expm1(F.col("base") + predicted(x, "numbers")))
    both = rows.join(own, ["series_id", "horizon"], "left").select("series_id", "t_idx", "horizon", "scenario", "share", made("x").alias("base_value"), made("changed").alias("scenario_value"))
    delta = F.col("scenario_value") - F.col("base_value")
    return both.select("series_id", "t_idx", "horizon", "scenario", "base_value", "scenario_value", delta.alias("delta"), F.when(F.col("base_value") > 0, delta / F.col("base_value") / F.col("share")).alias("elasticity"))
