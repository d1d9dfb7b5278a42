"""Near copies of the pipeline against brute force: no link of the similarity is lost, whatever the fingerprints find."""

import numpy as np
import pyarrow as pa
import pytest

from oriel.llm import simhash


def grams(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def components(rows):
    sets, root = {k: grams(t) for k, t in rows.items()}, {k: k for k in rows}
    for a in rows:
        for b in rows:
            common = len(sets[a] & sets[b])
            if a < b and common / (len(sets[a]) + len(sets[b]) - common) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def made_texts():
    rng, texts = np.random.default_rng(5), []
    passage = [f"p{x}" for x in range(30)]
    for base in range(150):  # pairs near the threshold, of equal and of different sizes
        words = [f"w{x}" for x in rng.integers(0, 3000, 120)] + passage
        at = rng.choice(120, 3 if base % 5 else 4, replace=False)
        texts += [" ".join(words), " ".join(f"new{x}" if x in at else w for x, w in enumerate(words[: 150 - base % 3]))]
    family = [f"f{x}" for x in range(200)]
    for _ in range(60):  # a dense group whose members are alike here and there
        at = rng.choice(200, int(rng.integers(2, 7)), replace=False)
        texts.append(" ".join(f"v{rng.integers(1000)}" if x in at else w for x, w in enumerate(family)))
    return dict(enumerate([*texts, "", "one", "one two", "one two three four five", "one two three four five six"]))


@pytest.mark.parametrize("partners, common", [(16, 1 << 17), (0, 1 << 17), (16, 0)])
def test_no_link_is_lost(spark, monkeypatch, partners, common):
    monkeypatch.setattr(simhash, "MANY_PARTNERS", partners, raising=False)
    monkeypatch.setattr(simhash, "MOST_COMMON", common, raising=False)
    rows = made_texts()
    table = spark.createDataFrame([*rows.items(), (0, rows[0])], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_components(table, scheme=simhash.SIMILAR).collect()}
    wanted = components(rows)
    assert {k: (found[k], g) for k, g in wanted.items() if found[k] != g} == {}
    assert sum(k != g for k, g in wanted.items()) > 100


def test_shared_rows_over_batches():
    rng = np.random.default_rng(2)
    for _ in range(40):
        rows = sorted((int(t), int(s)) for t, s in rng.integers(0, (12, 4), (30, 2)))
        cuts = [0, *sorted(rng.integers(0, 31, 9).tolist()), 30]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[a:b]], pa.int64()) for k in (0, 1)], ["token", "set"]) for a, b in zip(cuts, cuts[1:], strict=False)]
        found = [(r["token"], r["set"]) for b in simhash._shared(iter(batches)) for r in b.to_pylist()]
        sets = {t: {s for u, s in rows if u == t} for t, _ in rows}
        assert found == sorted((t, s) for t in sets for s in sets[t] if len(sets[t]) > 1)


def test_pairs_across_groups_are_few_and_whole(spark, monkeypatch):
    """Passage in 200 sets whose rarer first shingles are their own: 59,700 rows were joined for it, and none can be similar; pairs of other sizes must stay."""
    rng, sets = np.random.default_rng(7), {}
    for k in range(200):
        sets[k] = {*range(k * 10, k * 10 + 6), *range(5000, 5034)}
    for k in range(200, 500):
        size = int(rng.integers(5, 60))
        base = rng.choice(3000, size, replace=False) + 10_000 * (1 + k % 40)
        sets[k] = {*base.tolist()}
        if k > 200 and k % 3:
            other = sorted(sets[k - 1])
            sets[k] = {*other[int(rng.integers(0, 1 + len(other) // 5)) :], *base[: int(rng.integers(0, 1 + len(other) // 8))].tolist()}
    first = {k: sorted(s)[: len(s) - int(simhash.at_least(0.8, len(s))) + 1] for k, s in sets.items()}
    holders = {}
    for k, tokens in first.items():
        for x in tokens:
            holders.setdefault(x, []).append(k)
    rows = [(x, k, len(sets[k]), str(k), len(found)) for x, found in holders.items() if len(found) > 1 for k in found]
    met, real = [], simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, label: met.append(real(df, label)) or met[-1])
    crossing = spark.createDataFrame(rows, "token long, set long, size long, root string, n long")
    found = {(r["a"], r["b"]) for r in simhash._pairs_across(crossing, 0.8).collect()}
    common = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    wanted = {(a, b) for (a, b), c in common.items() if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8}
    assert wanted <= found and len(wanted) > 50
    assert len({len(sets[a]) - len(sets[b]) for a, b in wanted}) > 5
    assert met[0].where("a < 200").count() == 0


@pytest.mark.parametrize("before", [64, 1])
def test_pairs_of_a_family_meet_once(spark, monkeypatch, before):
    """A family just around the threshold, in groups of its own: 53,283 rows were joined for 1,770 pairs, and each must be joined once."""
    monkeypatch.setattr(simhash, "NEAR_BEFORE", before, raising=False)
    rng = np.random.default_rng(11)
    sets = {k: {*(1000 + np.flatnonzero(rng.random(300) < 0.84 + 0.1 * (k % 7) / 6)).tolist(), 10_000 + k} for k in range(60)}
    holders = {}
    for k, s in sets.items():
        for x in sorted(s)[: len(s) - int(simhash.at_least(0.8, len(s))) + 1]:
            holders.setdefault(x, []).append(k)
    rows = [(x, k, len(sets[k]), str(k), len(found)) for x, found in holders.items() if len(found) > 1 for k in found]
    crossing = spark.createDataFrame(rows, "token long, set long, size long, root string, n long")
    joined, real = [], type(crossing).distinct
    monkeypatch.setattr(type(crossing), "distinct", lambda df: joined.append(df) or real(df))
    found = {(r["a"], r["b"]) for r in simhash._pairs_across(crossing, 0.8).collect()}
    common = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    wanted = {(a, b) for (a, b), c in common.items() if c / (len(sets[a]) + len(sets[b]) - c) >= 0.8}
    assert wanted <= found and 200 < len(wanted) < len(common) - 200
    if before == 64:
        assert joined[0].count() == real(joined[0].select("a", "b")).count()
