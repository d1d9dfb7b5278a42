"""Exact k-means over integer vectors by Exponion search.

Each vector keeps its cluster and a lower bound of the distance to any other centroid. A round
computes the exact distance u to its own centroid; if u is below the bound, or below half the
way to the nearest other centroid, the cluster stays. Otherwise only centroids in a ball around
its own one are looked at: those no farther from it than 2u plus the way to its nearest
neighbour, taken from a list of the other centroids sorted by distance. The ball holds the
nearest and the second nearest centroid; its edge belongs to it, and what may be decided by
equality is searched, so ties go to the smaller number as in a full scan.

A round is one pass over a staged table, in Arrow batches: tasks write the vectors with their new
cluster and bound and, as last rows, their sums by cluster. What reaches the driver is one row a
cluster. Nothing is shuffled but these sums. The table of the round before is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.session import release, stage
from oriel.sources import read_table

WIDTH, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256
#: Components up to this size keep squared distances within 64 bits, and up to that one within what floats add exactly.
MOST_SIZE, FLOAT_SIZE = 1 << 27, 1 << 22
#: Bounds are rounded towards the safe side by this share.
SLACK = 1e-9


def whole_vectors(rows: DataFrame, vector_col: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """rows whose vector has `width` known finite components, with `v`: the integers floor(scale * component).

    A component beyond MOST_SIZE / scale raises: squared distances would pass 64 bits.
    """
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    number = lambda e: F.floor(e.cast("double") * scale)
    small = lambda e: F.when(F.abs(e.cast("double") * scale) < MOST_SIZE, number(e)).otherwise(F.raise_error(F.lit(f"a component's size is {MOST_SIZE / scale:g} or more")).cast("long"))
    return rows.where((F.size(x) == width) & fine).withColumn("v", F.transform(x, lambda e: small(e).cast("int")))


def first_centroids(vectors: DataFrame, id_col: str, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors of the rows with the least hexadecimal sha256 of `2:` and their id (nothing for a null one), then by components; fewer if there are fewer."""
    digest = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    found = vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    return np.array([r["v"] for r in found], np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= FLOAT_SIZE:
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


class Exponion:
    """The centroids of a round: sorted lists of the others around each, and how far any but one has moved."""

    def __init__(self, centroids: np.ndarray, moved: np.ndarray) -> None:
        self.centroids = centroids
        between = squares(centroids, centroids)
        self.order = np.argsort(between, axis=1, kind="stable")  # its own place comes first, or one equal to it
        self.between = np.take_along_axis(between, self.order, axis=1)
        np.fill_diagonal(between, np.iinfo(np.int64).max)
        self.nearest = between.min(axis=1)
        self.drift = np.array([np.delete(moved, k).max(initial=0.0) for k in range(len(moved))]) * (1 + SLACK)

    def assign(self, x: np.ndarray, cluster: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New cluster, lower bound to any other centroid, and squared distance of each row."""
        cluster = cluster.copy()
        apart = np.maximum(apart - self.drift[cluster], 0.0)
        u2 = ((x - self.centroids[cluster]) ** 2).sum(1)
        u = np.sqrt(u2.astype(float))
        near = np.sqrt(self.nearest.astype(float))
        keeps = (u * (1 + SLACK) < apart) | (2 * u * (1 + SLACK) < near[cluster] * (1 - SLACK))
        left = np.flatnonzero(~keeps)
        for k in np.unique(cluster[left]) if len(self.centroids) > 1 else ():
            own = left[cluster[left] == k]
            radius = (2 * u[own] + near[k]) * (1 + SLACK)
            inside = np.searchsorted(np.sqrt(self.between[k].astype(float)), radius, side="right")
            # Balls are taken together by size, to the next power of two.
            sizes = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(int), len(self.centroids))
            for m in np.unique(sizes):
                at = own[sizes == m]
                among = np.sort(self.order[k, :m])  # by number, so the first of equals is the smallest
                d = squares(x[at], self.centroids[among])
                best = d.argmin(axis=1)
                rows = np.arange(len(at))
                cluster[at], u2[at] = among[best], d[rows, best]
                d[rows, best] = np.iinfo(np.int64).max
                apart[at] = np.sqrt(d.min(axis=1).astype(float)) * (1 - SLACK)
        return cluster, apart, u2


def _round(search: Exponion) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k, width = search.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, sums = None, [[0] * (width + 2) for _ in range(k)]  # count, squared distances, components
        for batch in batches:
            form, at = batch.schema, batch.num_columns - 5
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
            cluster, apart, u2 = search.assign(x, batch.column(at + 1).to_numpy(zero_copy_only=False), batch.column(at + 2).to_numpy(zero_copy_only=False))
            for c in np.unique(cluster).tolist():
                own = cluster == c
                within = int(u2[own].sum()) if u2.max() < 1 << 40 else sum(u2[own].tolist())
                sums[c] = [s + n for s, n in zip(sums[c], [int(own.sum()), within, *x[own].sum(0).tolist()], strict=True)]
            state = [pa.array(cluster, pa.int32()), pa.array(apart), pa.array(u2), pa.nulls(batch.num_rows, form.field("sums").type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], *state], schema=form)
        if form is not None:
            full = [c for c in range(k) if sums[c][0]]
            ends = {"cluster": pa.array(full, pa.int32()), "sums": pa.array([sums[c] for c in full], form.field("sums").type)}
            yield pa.RecordBatch.from_arrays([ends.get(f.name, pa.nulls(len(full), f.type)) for f in form], schema=form)

    return run


def cluster_vectors(rows: DataFrame, keep: list[str], vector_col: str, id_col: str, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> DataFrame:
    """Columns keep of the rows with a whole vector, and cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Centroids start as first_centroids() and move to the floor of their vectors' means; empty
    ones stay. Sums beyond 64 bits raise. Other rows are left out; no vectors give no rows. keep
    must have none of the new names; other columns of rows don't matter, whatever their names.
    """
    spark, names = rows.sparkSession, [f"kept{k}" for k in range(len(keep))]
    whole = whole_vectors(rows.select(*[rows[c].alias(n) for c, n in zip(keep, names, strict=True)], rows[id_col].alias("id"), rows[vector_col].alias("x")), "x", width)
    state = stage(whole.select(*names, "id", "v", F.lit(0).alias("cluster"), F.lit(0.0).alias("apart"), F.lit(0).cast("long").alias("distance"), F.lit(None).cast("array<long>").alias("sums")), "vectors")
    centroids = first_centroids(state, "id", clusters)
    moved = np.zeros(len(centroids))
    table = {}
    for last in range(rounds + 1) if len(centroids) else ():
        after = stage(state.where("v is not null").mapInArrow(_round(Exponion(centroids, moved)), state.schema), "vectors")
        release(state)
        state = after
        found = state.where("v is null").groupBy("cluster").agg(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width + 2)])
        table = {r[0]: [int(x) for x in r[1:]] for r in found.collect()}  # one row a cluster
        if last < rounds:
            after = np.array([[x // table[c][0] for x in table[c][2:]] if c in table else row.tolist() for c, row in enumerate(centroids)], np.int64)
            moved = np.sqrt(((after - centroids).astype(float) ** 2).sum(1))
            centroids = after
    total = sum(t[1] for t in table.values())
    digests = [(c, t[1], total, sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, t in table.items()]
    ends = spark.createDataFrame(digests, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    own = state.where("v is not null").select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "cluster", "distance")
    return own.join(F.broadcast(ends), "cluster").select(*keep, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # one row a cluster


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read_table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", "vec_id")


def _op11_sql() -> str:
    """Full scans over all centroids, round by round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS place, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {WIDTH})""",
        f"c0 AS MATERIALIZED (SELECT CAST(place AS INTEGER) AS cluster, v AS c FROM kept WHERE place < {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        squared = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{k} AS MATERIALIZED (SELECT place, min(struct_pack(d := CAST({squared} AS BIGINT), cluster := cluster)) AS best FROM kept, c{k} GROUP BY place)")
        if k < ROUNDS:
            parts.append(f"m{k} AS (SELECT cluster, list(mean ORDER BY dim) AS c FROM (SELECT best.cluster AS cluster, dim, CAST(floor(sum(v[dim])::DOUBLE / count(*)) AS BIGINT) AS mean FROM kept JOIN a{k} USING (place), range(1, {WIDTH + 1}) AS t(dim) GROUP BY 1, 2) GROUP BY cluster)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (cluster))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, best.cluster AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN kept USING (place) JOIN c{ROUNDS} o ON o.cluster = best.cluster"""


OP11_SQL = _op11_sql()
