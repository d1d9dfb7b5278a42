"""Physical baseline with a kernel that follows the state of the plant, and the state vector of the residual models.

A row's time constant comes from its own level and flow. Its kernel is geometric, cut where it
falls under 5 % and scaled to mass one. All of it reads one window of the last `TAPS` values, so
a series is sorted once; there is no join of rows with taps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Taps of the longest kernel, that of a time constant of 24 hours.
TAPS, STEP_HOURS = 36, 2.0
HORIZONS = (1, 2, 3, 4, 5, 6)
#: Series that stand for the plant's: source of the baseline, raw turbidity, dose, flows and level.
ROLES = {"filt": "filt", "rw": "rw", "alum": "alum", "rw_flow": "k", "tw_flow": "flow", "level": "ph"}

STATE_NAMES = [
    *(f"residual_lag{k}" for k in range(6)),
    "log_filt", "log_filt_lag1", "delta_log_filt", "log_rw", "log_rw_lag1", "delta_log_rw",
    "alum", "rw_flow", "tw_flow", "level",
    "alum_missing", "rw_flow_missing", "tw_flow_missing", "level_missing",
    "hour_sin", "hour_cos", "year_sin", "year_cos",
]


def time_constant(base: Column, level: Column, flow: Column, mid_level: Column, mid_flow: Column) -> Column:
    """base * (level / median) / (flow / median), from 2 to 24; a null level, or a null or no positive flow, counts as the median."""
    flow_share = F.coalesce(F.when(flow > 0, flow) / mid_flow, F.lit(1.0))
    return F.greatest(F.lit(2.0), F.least(F.lit(24.0), base * F.coalesce(level / mid_level, F.lit(1.0)) / flow_share))


def convolve(recent: str, tau: str, other: str, ahead: int = 0, last: str = "null") -> Column:
    """The kernel of tau over recent, an array of structs v up to the current row, `ahead` steps later.

    What is not known yet is `last`, what lies before the series its first value, and a null `other`.
    """
    taps, q = f"cast(ceil(round(ln(0.05D) * {tau} / -{STEP_HOURS}D, 9)) as int)", f"exp(-{STEP_HOURS}D / {tau})"
    value = f"if(k < {ahead}, {last}, {recent}[greatest(size({recent}) - 1 - k + {ahead}, 0)].v)"
    total = f"aggregate(sequence(0, {taps} - 1), 0D, (s, k) -> s + pow({q}, k) * coalesce({value}, {other}))"
    return F.expr(f"{total} * (1 - {q}) / (1 - pow({q}, {taps}))")


def _recent(slots: DataFrame, train_before: int, roles: dict[str, str]) -> DataFrame:
    """slots with the last TAPS source values, the last known one, and the medians that stand for gaps."""
    early = lambda c: F.median(F.when(F.col("t_idx") < train_before, F.col(roles[c]).cast("double")))
    mids = slots.groupBy("series_id").agg(early("level").alias("_level"), early("tw_flow").alias("_flow"), F.median(roles["filt"]).alias("_mid"))
    by = Window.partitionBy("series_id").orderBy("t_idx")
    recent = F.collect_list(F.struct(F.col(roles["filt"]).alias("v"))).over(by.rowsBetween(1 - TAPS, 0))
    return slots.withColumns({"_recent": recent, "_last": F.last(roles["filt"], True).over(by)}).join(mids, "series_id")


def _tau(base: Column, roles: dict[str, str]) -> Column:
    return time_constant(base, F.col(roles["level"]), F.col(roles["tw_flow"]), F.col("_level"), F.col("_flow"))


def with_physical(slots: DataFrame, tau: float = 8.0, train_before: int = 240, roles: dict[str, str] = ROLES) -> DataFrame:
    """slots with tau, physical (the baseline of the row) and ahead1 to ahead6 (its forecast, made at the row for that many steps later).

    Medians of level and flow are those of each series before train_before; that of the source
    over all of it fills a row without a value of its own. In a forecast the last known value
    stands for gaps and for what comes later; before the first known value it is null.
    """
    rows = _recent(slots, train_before, roles).withColumn("tau", _tau(F.lit(tau), roles))
    own = f"coalesce(`{roles['filt']}`, _mid)"
    out = {"physical": convolve("_recent", "tau", own)} | {f"ahead{h}": F.when(F.col("_last").isNotNull(), convolve("_recent", "tau", "_last", h, "_last")) for h in HORIZONS}
    return rows.withColumns(out).drop("_recent", "_last", "_level", "_flow", "_mid")


def with_baselines(slots: DataFrame, taus: tuple[int, ...], train_before: int = 240, roles: dict[str, str] = ROLES) -> DataFrame:
    """slots with physical_2, physical_4, ...: the baseline of each row for several time constants, over one window."""
    rows = _recent(slots, train_before, roles).withColumns({f"_tau{t}": _tau(F.lit(float(t)), roles) for t in taus})
    own = f"coalesce(`{roles['filt']}`, _mid)"
    return rows.withColumns({f"physical_{t}": convolve("_recent", f"_tau{t}", own) for t in taus}).select(*slots.columns, *[f"physical_{t}" for t in taus])


def kernel(tau: str, tap: str) -> Column:
    """The weight of a tap in the kernel of a time constant, columns both; null beyond its last tap."""
    taps, q = f"cast(ceil(round(ln(0.05D) * {tau} / -{STEP_HOURS}D, 9)) as int)", f"exp(-{STEP_HOURS}D / {tau})"
    return F.expr(f"if({tap} < {taps}, pow({q}, {tap}) * (1 - {q}) / (1 - pow({q}, {taps})), null)")


def with_state(rows: DataFrame, target: str = "ntu", roles: dict[str, str] = ROLES, override: dict[str, Column] | None = None) -> DataFrame:
    """rows of with_physical() with residual, the 24 columns of STATE_NAMES and available (the last six residuals are known).

    The residual is the difference of the logarithms (of one more) of target and physical.
    override: what stands for rw or alum at the row itself, as in a scenario.
    """
    by, now = Window.partitionBy("series_id").orderBy("t_idx"), override or {}
    rows = rows.withColumn("residual", F.log1p(target) - F.log1p("physical"))
    filt, rw = F.log1p(roles["filt"]), F.log1p(now.get("rw", F.col(roles["rw"])))
    inputs = {"alum": now.get("alum", F.col(roles["alum"]))} | {c: F.col(roles[c]) for c in ("rw_flow", "tw_flow", "level")}
    hour, day = (F.hour("ts") + F.minute("ts") / 60) * (2 * 3.141592653589793 / 24), F.dayofyear("ts") * (2 * 3.141592653589793 / 365.25)
    columns = {f"residual_lag{k}": F.lag("residual", k).over(by) if k else F.col("residual") for k in range(6)}
    columns |= {"log_filt": filt, "log_filt_lag1": F.lag(filt, 1).over(by), "log_rw": rw, "log_rw_lag1": F.lag(F.log1p(roles["rw"]), 1).over(by)}
    columns |= {"delta_log_filt": columns["log_filt"] - columns["log_filt_lag1"], "delta_log_rw": columns["log_rw"] - columns["log_rw_lag1"]}
    columns |= {f"{c}_missing": x.isNull().cast("double") for c, x in inputs.items()}
    columns |= {"hour_sin": F.sin(hour), "hour_cos": F.cos(hour), "year_sin": F.sin(day), "year_cos": F.cos(day)}
    columns |= {"available": F.count("residual").over(by.rowsBetween(-5, 0)) == 6, "_inputs": F.struct(*[x.cast("double").alias(c) for c, x in inputs.items()])}
    made = rows.withColumns(columns)
    return made.withColumns({c: F.col(f"_inputs.{c}") for c in inputs}).drop("_inputs")
