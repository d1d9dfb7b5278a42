"""Quality rules: rule statistics judged by an isolation forest.

Two rules fail a document outright: fewer than 10 words, or more than a fifth of its words in
five-word windows that occur twice or more. The others get the mean depth at which random
splits isolate their statistics; the anomaly score is 2 ** (-depth / expected depth). The trees
are grown on a bounded sample of labelled rows, the threshold comes from the scores of all
labelled rows: of those that keep `KEEP_GOOD` of the good documents, the one that parts the two
labels best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.statistics import COUNTS, RATIOS, text_statistics
from oriel.llm.text import least_hashed
from oriel.session import stage
from oriel.sources import read_table

TREES, SUBSAMPLE, SEED = 128, 256, 20
#: Bound of the sample of labelled rows that the trees are grown on.
MOST_LABELLED = 20_000
#: Share of the rows with label 1 that any threshold must keep, and the bins of scores.
KEEP_GOOD, BINS = 0.99, 1000
#: What the trees may split on.
FEATURES = ("mean_word", "long_words", "symbols", "pipes", "exclaims", "stops", "capitals", "digits", "marks", "dup_lines", "repeat_words", "bare_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow_tree(points: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    """Nodes (feature, split, left, right, depth of a leaf); feature -1: a leaf.

    Splits are uniform over the node's part of the box from low to high, not over its points: a
    statistic that is zero for every good document can still part off one that has it.
    """
    nodes: list = [None]
    todo = [(0, points, low, high, 0)]
    while todo:
        at, own, low, high, depth = todo.pop()
        free = np.flatnonzero(high > low)
        if depth >= most or len(own) < 2 or not len(free):
            nodes[at] = (-1, 0.0, 0, 0, depth + float(expected_depth(len(own))))
            continue
        feature = int(rng.choice(free))
        split = float(rng.uniform(low[feature], high[feature]))
        left = own[:, feature] < split
        nodes[at] = (feature, split, len(nodes), len(nodes) + 1, 0.0)
        nodes += [None, None]
        below, above = high.copy(), low.copy()
        below[feature] = above[feature] = split
        todo += [(len(nodes) - 2, own[left], low, below, depth + 1), (len(nodes) - 1, own[~left], above, high, depth + 1)]
    return np.array(nodes)


def grow_forest(points: np.ndarray, box: np.ndarray, seed: int = SEED) -> tuple[list[np.ndarray], int]:
    """TREES trees as arrays of nodes, and the number of points that each has seen. box: rows that span the splits."""
    rng, size = np.random.default_rng(seed), min(SUBSAMPLE, len(points))
    if size < 2:
        return [], size
    low, high, most = box.min(axis=0), box.max(axis=0), 2 * int(np.ceil(np.log2(size)))
    return [grow_tree(points[rng.choice(len(points), size, replace=False)], low, high, rng, most) for _ in range(TREES)], size


def anomaly(points: np.ndarray, forest: tuple[list[np.ndarray], int]) -> np.ndarray:
    """From 0 to 1, higher for points that few splits isolate; 0 without trees."""
    trees, size = forest
    if not trees or size < 2:
        return np.zeros(len(points))
    depth = np.zeros(len(points))
    for tree in trees:
        at = np.zeros(len(points), np.int64)
        for _ in range(64):
            feature = tree[at, 0].astype(np.int64)
            inner = feature >= 0
            if not inner.any():
                break
            left = points[np.arange(len(points)), np.maximum(feature, 0)] < tree[at, 1]
            at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64), at)
        depth += tree[at, 4]
    return 2.0 ** (-depth / len(trees) / float(expected_depth(size)))


def _scorer(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.stack([batch.column(batch.schema.get_field_index(f)).to_numpy() for f in FEATURES], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(anomaly(points, sent.value))], [*batch.schema.names, "anomaly"])

    return score


def best_threshold(bins: list[tuple[int, int, int]]) -> float:
    """Largest score that is kept, from rows (bin, good, bad): parts the labels best among those that keep KEEP_GOOD of the good."""
    good, bad = sum(g for _, g, _ in bins), sum(b for _, _, b in bins)
    best, most, kept_good, kept_bad = 1.0, -1.0, 0, 0
    for at, g, b in sorted(bins):
        kept_good, kept_bad = kept_good + g, kept_bad + b
        parted = kept_good / max(good, 1) - kept_bad / max(bad, 1)
        if kept_good >= KEEP_GOOD * good and parted > most:
            best, most = (at + 1) / BINS, parted
    return best


def judge(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """statistics with base_failed, anomaly and kept, which replace columns of these names; labels: rows (doc_id, quality).

    Of at most MOST_LABELLED labelled rows that pass the two rules, those with quality 1 grow the
    trees and all of them span the splits. A row with two labels counts as bad if one says so. Without
    labelled rows the forest is empty, every anomaly is 0 and only the two rules decide.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ruled = statistics.drop("anomaly", "kept").withColumn("base_failed", base_failed())
    labelled = stage(ruled.where("not base_failed").join(known, "doc_id").select("doc_id", "quality", *FEATURES), "labelled-statistics")
    sample = least_hashed(labelled, MOST_LABELLED).select("quality", *FEATURES).toPandas()
    rows = sample[list(FEATURES)].to_numpy(np.float64)
    sent = statistics.sparkSession.sparkContext.broadcast(grow_forest(rows[sample["quality"] == 1], rows))
    fields = lambda df: ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "anomaly double"])
    scored = labelled.mapInArrow(_scorer(sent), fields(labelled))
    bins = scored.groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    threshold = best_threshold([(r["bin"], r["good"], r["bad"]) for r in bins.collect()])  # BINS rows at most
    return ruled.mapInArrow(_scorer(sent), fields(ruled)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text has no words and fails; repeated rows are judged alike."""
    statistics = stage(text_statistics(read_table(spark, sf_dir, "documents")), "statistics")
    judged = judge(statistics, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
