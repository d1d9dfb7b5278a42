"""Daily risk and filled gaps against plain loops, series side by side."""

import random

import pytest

from oriel.operators import risk


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    level = {"calm": (30, 60), "high": (40, 90), "edge": (55, 55), "none": (0, 0)}
    return [(s, t, f"2024-01-{1 + t // 12:02d}", None if s == "none" or rng.random() < 0.2 else round(rng.uniform(*level[s]), 3)) for s in level for t in range(96)]


@pytest.fixture(scope="module")
def slots(spark, rows):
    return spark.createDataFrame(rows, "series_id string, t_idx long, op_day string, ntu double").repartition(5)


def day_of(values):
    run = best = 0
    for v in values:
        run = run + 1 if v > 55 else 0
        best = max(best, run)
    over = [max(v - 55, 0) for v in values]
    return len(values), max(values), max(over), best * 2, sum(over) * 2


def grade_of(n, amplitude, hours, low=10, medium=20, brief=4, lasting=8):
    if n < 9:
        return "INSUFFICIENT"
    return "SAFE" if amplitude <= 0 else "LOW" if amplitude <= low and hours <= brief else "MEDIUM" if amplitude <= medium and hours <= lasting else "HIGH"


@pytest.fixture(scope="module")
def days(rows):
    keys = sorted({(s, d) for s, _, d, v in rows if v is not None})
    return {k: day_of([v for s, _, d, v in rows if (s, d) == k and v is not None]) for k in keys}


def test_days_and_grades(slots, days):
    found = {(r["series_id"], r["op_day"]): r for r in risk.daily_risk(slots).withColumn("grade", risk.grade()).collect()}
    assert set(found) == set(days)
    for k, (n, most, amplitude, hours, load) in days.items():
        r = found[k]
        assert (r["valid_points"], r["max_value"], r["longest_hours"]) == (n, most, hours)
        assert r["amplitude"] == pytest.approx(amplitude) and r["exceedance_load"] == pytest.approx(load)
        assert r["grade"] == grade_of(n, amplitude, hours)
    assert len({r["grade"] for r in found.values()}) >= 4


def test_unchanged_share(slots, days):
    found = risk.unchanged_share(risk.daily_risk(slots), (8.0, 12.0), (20.0,), (2, 6), (8,)).collect()
    assert len(found) == 4 * 3  # a series without values has no days
    for r in found:
        own = [v for (s, _), v in days.items() if s == r["series_id"]]
        same = [grade_of(n, a, h) == grade_of(n, a, h, r["low"], r["medium"], r["brief"], r["lasting"]) for n, _, a, h, _ in own]
        assert r["unchanged"] == pytest.approx(sum(same) / len(same))


def test_interpolated(slots, rows):
    found = {(r["series_id"], r["t_idx"]): r["filled"] for r in risk.interpolated(slots, "ntu", 2).collect()}
    assert len(found) == len(rows)
    for name in ("calm", "high", "edge", "none"):
        known = {t: v for s, t, _, v in rows if s == name and v is not None}
        for t in range(96):
            p, q = max((k for k in known if k <= t), default=None), min((k for k in known if k >= t), default=None)
            if p is None or q is None:
                expected = known.get(p if q is None else q)
            else:
                expected = known[p] if p == q else known[p] + (known[q] - known[p]) * min(t - p, 2) / (q - p)
            assert found[name, t] == pytest.approx(expected)
