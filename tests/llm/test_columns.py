"""Extra columns whose names clash with what operators make or use inside, passed through them."""

import pytest

from oriel.llm import pieces, quality_rules, sharding, statistics, token_counts, toxicity

NAMES = ["block", "_first", "first", "second", "_second", "part", "_part", "start", "rank", "n", "counts", "ends", "shard", "slot", "_text", "kept0", "score", "n_tokens", "token_ids", "round_trip", "n_bytes", "anomaly", "kept"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, f"text number {k % 7}" if k % 5 else None, *[f"{c}-{k}" for c in NAMES]) for k in range(40)]
    return spark.createDataFrame(data, ", ".join(["doc_id long", "text string", *[f"{c} string" for c in NAMES]])).repartition(3)


def stays(found, made):
    """All columns but those that are made hold what they held."""
    assert len(found) == 40
    for r in found:
        assert all(r[c] == f"{c}-{r['doc_id']}" for c in NAMES if c not in made)


def test_shards(rows):
    found = sharding.shuffle_into_shards(rows, ["doc_id"], 4).collect()
    stays(found, ["shard", "slot"])
    assert sorted((r["shard"], r["slot"]) for r in found) == [(s, k) for s in range(4) for k in range(10)]
    plain = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(rows.select("doc_id"), ["doc_id"], 4).collect()}
    assert plain == {r["doc_id"]: (r["shard"], r["slot"]) for r in found}


def test_pieces_counts_and_scores(rows):
    model = toxicity.fit_toxicity(rows.selectExpr("doc_id", "text", "cast(doc_id % 2 as int) as label"))
    stays(pieces.encode_texts(rows, rows.columns).collect(), ["token_ids", "n_tokens", "round_trip"])
    stays(token_counts.count_tokens(rows, rows.columns).collect(), ["n_bytes", "n_tokens"])
    scored = toxicity.score_toxicity(rows, model, rows.columns).collect()
    stays(scored, ["score"])
    assert all(isinstance(r["score"], float) for r in scored)


def test_judged(spark, rows):
    made = statistics.text_statistics(rows.select("doc_id", "text")).selectExpr("*", "'x' as anomaly", "'y' as kept")
    found = quality_rules.judge(made, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality long")).collect()
    assert len(found) == 40 and all(isinstance(r["anomaly"], float) and isinstance(r["kept"], bool) for r in found)
