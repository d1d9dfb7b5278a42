"""Quality classifier: a sparse rule ensemble.

Shallow trees are grown on statistics of labelled texts; every path from a root to a node is a
rule, a conjunction of comparisons. A logistic regression with an absolute-value penalty over
all rules leaves few of them, and these become one Spark column expression: scoring needs the
statistics and whole-stage code alone, no model object on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.statistics import RATIOS, text_statistics
from oriel.llm.text import least_hashed
from oriel.session import stage
from oriel.sources import read_table

TREES, DEPTH, SEED = 24, 3, 4
#: Bound of the training sample, in rows.
MOST_LABELLED = 20_000
#: Weight of the absolute-value penalty.
PENALTY = 0.002

#: A rule: (feature, whether at most, bound) for each comparison.
Rule = tuple[tuple[str, bool, float], ...]


def tree_rules(tree: DecisionTreeClassificationModel, names: list[str]) -> list[Rule]:
    """The paths to all nodes below the root of a tree, from its nodes."""
    found, waiting = [], [(tree._call_java("rootNode"), ())]
    while waiting:
        node, path = waiting.pop()
        found += [path] if path else []
        if node.subtreeDepth():
            name, bound = names[node.split().featureIndex()], node.split().threshold()
            waiting += [(node.leftChild(), (*path, (name, True, bound))), (node.rightChild(), (*path, (name, False, bound)))]
    return found


def tidy(rule: Rule) -> Rule:
    """The same conjunction with one bound a feature and side, sorted."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, most, at in rule:
        key = (name, most)
        bounds[key] = at if key not in bounds else min(at, bounds[key]) if most else max(at, bounds[key])
    return tuple(sorted((name, most, at) for (name, most), at in bounds.items()))


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, most, at in rule:
        out = out & ((F.col(name) <= at) if most else (F.col(name) > at))
    return out


def fit_rules(labelled: DataFrame, features: list[str], label: str) -> tuple[list[tuple[Rule, float]], float]:
    """([(rule, weight)], intercept) from rows with the features and a 0/1 label, MOST_LABELLED at most.

    With a single label there are no rules and the intercept is 4 or -4 (0 without rows).
    """
    counts = {int(r[0]): r[1] for r in labelled.groupBy(label).count().collect()}
    if len(counts) < 2:
        return [], 0.0 if not counts else 4.0 if 1 in counts else -4.0
    rows = labelled.select(array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("features"), F.col(label).cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, minInstancesPerNode=5, subsamplingRate=0.5, featureSubsetStrategy="sqrt", maxBins=64).fit(rows)
    rules = sorted({tidy(r) for tree in forest.trees for r in tree_rules(tree, features)})
    if not rules:
        return [], 4.0 if counts[1] > counts[0] else -4.0
    matrix = labelled.select(array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features"), F.col(label).cast("double").alias("label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(matrix)
    return [(r, float(w)) for r, w in zip(rules, lasso.coefficients, strict=True) if abs(w) > 1e-6], float(lasso.intercept)


def compile_rules(rules: list[tuple[Rule, float]], intercept: float) -> Column:
    """The score, from 0 to 1, as an expression over the statistics."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def held_out() -> Column:
    """Rows that aren't learned from: crc32 of the id as text leaves 1 on division by 3."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def train_on_labels(statistics: DataFrame, labels: DataFrame) -> tuple[list[tuple[Rule, float]], float]:
    """fit_rules() on the statistics of the labelled rows with the least hashes of their ids; of two labels for an id the lower counts."""
    known = labels.where(~held_out()).where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = least_hashed(known, MOST_LABELLED)
    return fit_rules(stage(statistics.join(F.broadcast(known), "doc_id"), "labelled"), list(RATIOS), "quality")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have all statistics 0 and score by them; repeated rows score alike."""
    statistics = stage(text_statistics(read_table(spark, sf_dir, "documents")), "statistics")
    score = compile_rules(*train_on_labels(statistics, read_table(spark, sf_dir, "labels")))
    scored = statistics.select("doc_id", score.alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
