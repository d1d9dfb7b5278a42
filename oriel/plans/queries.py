"""Registry: every query of the series engine, and its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.operators.calendar import FOUR, FOUR_SLOTS_SQL, SLOTS_SQL, regular_slots
from oriel.operators.recursion import GAPS_SQL, fill_gaps
from oriel.operators.regression import Ridge, fit_ridge, permutation_importance
from oriel.plans import delays, forecast, frames, lagged as steps, records, risk, round_trips, searches
from oriel.plans.model_sql import MODEL_SQL
from oriel.plans.series_sql import SERIES_SQL
from oriel.sources import read_table

#: The relations of time constants (hours) and of kernel taps, as SQL of both engines.
TAUS = "(VALUES " + ", ".join(f"({t})" for t in range(2, 25, 2)) + ") AS taus(tau)"
TAPS = "(VALUES " + ", ".join(f"({k})" for k in range(40)) + ") AS taps(k)"


#: A day's rows in order, hashed.
DIGESTS = {"spark": "sha2(listagg(part, ';') WITHIN GROUP (ORDER BY t_idx), 256)", "duckdb": "sha256(string_agg(part, ';' ORDER BY t_idx))"}


def _fill(text: str, slots: str, events: str, ntz: str, engine: str) -> str:
    parts = {"{s}": slots, "{e}": events, "{taus}": TAUS, "{taps}": TAPS, "{ntz}": ntz, "{digest}": DIGESTS[engine]}
    for name, part in parts.items():
        text = text.replace(name, part)
    return text


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_slots(read_table(spark, sf_dir, "events"))


def _series_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(_fill(text, "{slots}", "{events}", "TIMESTAMP_NTZ", "spark"), slots=_slots(spark, sf_dir), events=read_table(spark, sf_dir, "events"))

    return run


def _series_oracle(text: str, slots: str = SLOTS_SQL) -> str:
    own = _fill(text, "slots", "events", "TIMESTAMP", "duckdb")
    return f"WITH {slots}" + (", " + own.removeprefix("WITH ") if own.startswith("WITH ") else own)


def gap_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_gaps(_slots(spark, sf_dir), "filt", "rw").select("t_idx", F.round("filled", 6).alias("filled"))


FACTORS = {x: [x, f"{x}_1", f"{x}_2"] for x in ("rw", "alum", "ph")}
#: Slots that models learn from come before this one.
TRAIN_BEFORE = 240


def lagged(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(FACTORS), steps: int = 2) -> DataFrame:
    """The slots with lags 1 to steps of the named series, over one window."""
    by = Window.partitionBy("series_id").orderBy("t_idx")
    return _slots(spark, sf_dir).withColumns({f"{x}_{k}": F.lag(x, k).over(by) for x in names for k in range(1, steps + 1)})


def _factor_model(rows: DataFrame) -> Ridge:
    return fit_ridge(rows.where(F.col("t_idx") < TRAIN_BEFORE), [f for fs in FACTORS.values() for f in fs], "ntu", 1.0, robust=True)


def huber_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a robust fit of ntu on nine lagged features."""
    m = _factor_model(lagged(spark, sf_dir))
    return spark.createDataFrame([*zip(m.features, map(float, m.weights), strict=True), ("intercept", m.intercept)], "feature string, weight double")


def block_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each factor matters to huber_ridge() on later slots."""
    rows = lagged(spark, sf_dir)
    return permutation_importance(rows.where(F.col("t_idx") >= TRAIN_BEFORE), _factor_model(rows), "ntu", FACTORS)


MODELS = {f.__name__: f for f in (huber_ridge, block_importance)}
#: Queries by series; those of BY_FOUR also run on four series side by side, from the same log.
BY_SERIES, BY_SERIES_SQL = frames.QUERIES | steps.QUERIES | risk.QUERIES | delays.QUERIES, frames.SQL | steps.SQL | risk.SQL | delays.SQL
BY_FOUR = ("timeline_gate", "carry_back", "spearman_matrix", "psi_drift", "fir_convolve", "skill_ratios", "residual_acf", "crosscorr_peak", "risk_grades", "risk_robustness_81", "impute_fill", "delay_grid", "bootstrap_spearman")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _series_query(text) for name, text in (SERIES_SQL | MODEL_SQL).items()} | {"gap_recursion": gap_recursion} | MODELS | BY_SERIES | {f"{n}_by_four": partial(BY_SERIES[n], series=FOUR) for n in BY_FOUR} | forecast.QUERIES | searches.QUERIES | records.QUERIES | round_trips.QUERIES
ORACLES: dict[str, str] = {name: _series_oracle(text) for name, text in (SERIES_SQL | MODEL_SQL).items()} | {"gap_recursion": f"WITH RECURSIVE {SLOTS_SQL}{GAPS_SQL}"} | forecast.ORACLES | records.ORACLES | round_trips.ORACLES | {name: _series_oracle(text) for name, text in BY_SERIES_SQL.items()} | {f"{n}_by_four": _series_oracle(BY_SERIES_SQL[n], FOUR_SLOTS_SQL) for n in BY_FOUR}
