"""Exponion search against full scans: ties, equal vectors, empty clusters, vectors that aren't whole."""

import hashlib

import numpy as np
import pytest

from oriel.llm import clustering


def brute(rows, clusters, rounds, width, scale=256):
    kept = [(k, [int(np.floor(scale * float(x))) for x in v]) for k, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own) if c == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    ends = [near(v) for _, v in kept]
    inertia = [sum(d for d, c in ends if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((k, c, d, inertia[c], sum(inertia), digest[c]) for (k, _), (d, c) in zip(kept, ends)), key=str)


def cases():
    rng = np.random.default_rng(5)
    grid = [(k, [float(x) for x in rng.integers(-2, 3, 4) / 256]) for k in range(300)]  # many ties
    blobs = [(1000 + k, [float(x) for x in rng.normal(k % 5, 0.05, 4)]) for k in range(200)]
    odd = [(None, [0.5, 0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5, 0.5]), (8, None), (9, []), (10, [1.0, None, 1.0, 1.0]), (11, [float("nan")] * 4), (12, [float("inf"), 0.0, 0.0, 0.0]), (13, [0.0] * 5)]
    return {"ties": (grid, 12), "blobs": (blobs + odd, 9), "one cluster": (blobs, 1), "fewer vectors": (odd, 40), "large": ([(k, [x * 60_000 for x in v]) for k, v in blobs], 9)}


@pytest.mark.parametrize("name", cases())
def test_clusters(spark, name):
    rows, clusters = cases()[name]
    df = spark.createDataFrame([(k, v, 1, 2, "s") for k, v in rows], "vec_id long, embedding array<double>, cluster int, v int, sums string").repartition(3)
    found = clustering.cluster_vectors(df, ["vec_id"], "embedding", "vec_id", clusters, 3, 4)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(rows, clusters, 3, 4)
    assert clustering.cluster_vectors(df.where("false"), ["vec_id"], "embedding", "vec_id", clusters, 3, 4).count() == 0


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e30] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="component"):
        clustering.cluster_vectors(df, ["vec_id"], "embedding", "vec_id", 2, 1, 4)


def test_search_skips_centroids(monkeypatch):
    rng, seen = np.random.default_rng(1), []
    centroids = rng.integers(-5000, 5000, (40, 8))
    x = centroids[rng.integers(0, 40, 2000)] + rng.integers(-300, 300, (2000, 8))
    search = clustering.Exponion(centroids, np.zeros(40))
    cluster, apart, u2 = search.assign(x, np.zeros(2000, np.int64), np.zeros(2000))
    full = clustering.squares(x, centroids)
    assert (cluster == full.argmin(1)).all() and (u2 == full.min(1)).all()
    assert (apart <= np.sqrt(np.sort(full, axis=1)[:, 1]) + 1e-6).all()
    real = clustering.squares
    monkeypatch.setattr(clustering, "squares", lambda a, b: seen.append(len(a) * len(b)) or real(a, b))
    again = clustering.Exponion(centroids + 10, np.full(40, 10 * np.sqrt(8)))
    seen.clear()
    second = again.assign(x, cluster, apart)[0]
    assert (second == real(x, centroids + 10).argmin(1)).all() and sum(seen) < 0.5 * 2000 * 40
