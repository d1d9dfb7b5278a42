"""Scores of the fitted models, recomputed in plain Python from what was fitted: rules, n-grams, trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.llm import quality_classifier, quality_rules, toxicity
from oriel.llm.statistics import RATIOS, text_statistics
from oriel.session import stage

SF = "/root/testdata/sf0.01"
TEXTS = ["", None, "a", "shut up you stupid idiot", "é水 |||| 12\n12\n" * 40, "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return real.union(spark.createDataFrame([(10**7 + k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def statistics(docs):
    return stage(text_statistics(docs), "test-statistics")


def test_quality_scores_by_rules(statistics, labels):
    rules, intercept = quality_classifier.train_on_labels(statistics, labels)
    assert rules and all(rule == quality_classifier.tidy(rule) for rule, _ in rules)
    scored = statistics.select(*RATIOS, quality_classifier.compile_rules(rules, intercept).alias("score")).toPandas()
    for row in scored.to_dict("records"):
        total = intercept + sum(w for rule, w in rules if all(row[name] <= at if most else row[name] > at for name, most, at in rule))
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def plain_keys(text):
    """The text's n-grams by their keys, from the key's definition with Python's own numbers."""
    codes = [ord(c) for c in f" {text.lower()} "]
    found = {}
    for width in toxicity.GRAMS:
        for i in range(len(codes) - width + 1):
            key = width
            for c in codes[i : i + width]:
                key = ((key ^ c) * 0x9E3779B97F4A7C15) % 2**64
                key ^= key >> 29
            found[key] = tuple(codes[i : i + width])
    return found


def test_toxicity_scores_by_n_grams(spark, docs, labels):
    model = toxicity.train_on_labels(docs, labels)
    keys, _, weights, intercept = model
    table = dict(zip(map(int, keys), weights.tolist(), strict=True))
    assert len(table) == len(keys) > 0
    chosen = docs.where((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) | (F.col("doc_id") >= 10**7))
    grams = {}
    for r in toxicity.score_toxicity(chosen, model, ["doc_id", "text"]).collect():
        own = plain_keys(r["text"] or "")
        for k in table.keys() & own.keys():
            assert grams.setdefault(k, own[k]) == own[k]  # no two n-grams under one key
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-intercept - sum(table[k] for k in own if k in table))), abs=1e-9)


def test_anomalies_by_walks(statistics, labels):
    """Growing the same forest again, and walking each row down every tree, gives the anomalies; the threshold parts them."""
    judged = quality_rules.judge(statistics, labels).toPandas()
    known = labels.toPandas().dropna(subset="quality").groupby("doc_id")["quality"].min()
    passed = judged[~judged["base_failed"]].merge(known.rename("quality"), left_on="doc_id", right_index=True)
    assert len(passed) <= quality_rules.MOST_LABELLED
    names = list(quality_rules.FEATURES)
    from oriel.llm.text import least_hashed

    frame = statistics.sparkSession.createDataFrame(passed[["doc_id", "quality", *names]].astype({"quality": int}))
    sample = least_hashed(frame, quality_rules.MOST_LABELLED).toPandas()
    rows = sample[names].to_numpy(float)
    trees, size = quality_rules.grow_forest(rows[sample["quality"] == 1], rows)
    harmonic = lambda n: 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def walk(tree, point):
        at = 0
        while tree[at][0] >= 0:
            at = int(tree[at][2] if point[int(tree[at][0])] < tree[at][1] else tree[at][3])
        return tree[at][4]

    some = judged.sample(150, random_state=3) if len(judged) > 150 else judged
    points = some[names].to_numpy(float)
    plain = [2 ** (-sum(walk(t, p) for t in trees) / len(trees) / harmonic(size)) for p in points]
    assert np.allclose(some["anomaly"], plain, atol=1e-9)
    kept, lost = judged[judged["kept"]], judged[~judged["kept"] & ~judged["base_failed"]]
    assert len(kept) and len(lost) and kept["anomaly"].max() < lost["anomaly"].min() and not (judged["kept"] & judged["base_failed"]).any()
    good = passed[passed["quality"] == 1]
    assert good["kept"].mean() >= quality_rules.KEEP_GOOD
