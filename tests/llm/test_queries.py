"""The registered queries and the pipeline's stages over whole small tables, against brute force."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from test_llm import ROWS, WORD, brute_runs, grams_of

from oriel.llm import pieces, registry, toxicity
from oriel.session import stage

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, _row string, _text string"


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls, repeated and equal rows, ties, empty and very long texts and clashing columns, over real ones; labels that repeat or are null."""
    path = str(tmp_path_factory.mktemp("odd"))
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = [(k + 1_000_000 if k is not None else None, t, None, s, None) for k, t, s in ROWS] + [(None, "another row without an id", "en", None, 4), (1_000_008, "same id, other text", None, "a", 1)]
    spark.createDataFrame([(*r, "f", "r", "t") for r in real + rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    more = [(1_000_001, 1, 0), (1_000_001, 0, 0), (1_000_003, None, None), (None, 1, 1), (5, 0, 1)]
    labels.select("doc_id", "quality", "toxic").union(spark.createDataFrame(more, "doc_id long, quality long, toxic long")).write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def bare(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bare"))
    for t in ("documents", "labels"):
        spark.read.parquet(f"{odd}/{t}.parquet").where("false").write.parquet(f"{path}/{t}.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").where("false").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def texts(spark, odd):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables_give_no_rows(spark, bare, name):
    assert registry.QUERIES[name](spark, bare).count() == 0


@pytest.mark.parametrize("name, parts, rest", [("op4_quality_classifier", 3, 1), ("op8_toxicity", 5, 0)])
def test_scores(spark, odd, texts, name, parts, rest):
    rows = registry.QUERIES[name](spark, odd).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in texts)
    for r in rows:
        crc = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode())
        assert r["held_out"] == (crc % parts == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert sorted(map(str, registry.QUERIES[name](spark, odd).collect())) == sorted(map(str, rows))


def test_held_out_accuracy(spark):
    labels = pd.read_parquet(f"{LARGER}/labels.parquet").drop_duplicates("doc_id")
    found = {n: registry.QUERIES[n](spark, LARGER).toPandas().merge(labels, on="doc_id") for n in ("op4_quality_classifier", "op8_toxicity")}
    quality, toxic = (f[f["held_out"]] for f in found.values())
    known = quality.dropna(subset="quality")
    assert len(known) > 60 and (known["predicted"] == known["quality"]).mean() >= 0.97
    assert toxic[toxic["toxic"] == 1]["predicted"].mean() >= 0.6 and toxic[toxic["toxic"] == 0]["predicted"].mean() <= 0.02


def test_held_out_labels_change_no_score(spark, odd, tmp_path):
    labels = spark.read.parquet(f"{odd}/labels.parquet").toPandas()
    held = labels["doc_id"].map(lambda k: zlib.crc32(("" if pd.isna(k) else str(int(k))).encode()))
    labels.loc[held % 5 == 0, "toxic"] = 1
    labels.loc[held % 3 == 1, "quality"] = 0
    spark.read.parquet(f"{odd}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    labels.astype({"doc_id": "Int64", "quality": "Int64", "toxic": "Int64"}).to_parquet(f"{tmp_path}/labels.parquet")
    for name in ("op4_quality_classifier", "op8_toxicity"):
        one, two = (sorted((str(r["doc_id"]), r["score"]) for r in registry.QUERIES[name](spark, d).collect()) for d in (odd, str(tmp_path)))
        assert [k for k, _ in one] == [k for k, _ in two] and np.allclose([s for _, s in one], [s for _, s in two])


def test_shards(spark, odd, texts):
    rows = registry.QUERIES["op5_shard_documents"](spark, odd).collect()
    made = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((k, *made(t)) for k, t in texts)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    assert sorted(map(str, registry.QUERIES["op5_shard_documents"](spark, odd).collect())) == sorted(map(str, rows))


def test_media_query(spark, odd, texts):
    rows = registry.QUERIES["op9_media_sequences"](spark, odd).collect()

    def made(text):
        data = (text or "").encode()
        payload = data + b"\xff" * (max(576, -(-len(data) // 576) * 576) - len(data))
        picture = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        sha = lambda x: hashlib.sha256(x).hexdigest()
        values = np.frombuffer(payload, np.uint8).astype(float)
        numbers = [values.mean(), values.std(), *[((values >= 64 * k) & (values < 64 * k + 64)).mean() for k in range(4)]]
        return len(data), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(picture), sha(picture), " ".join(f"{x:.6f}" for x in numbers), int(bool((text or "").split("\n")[0].strip())), None

    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")
    assert Counter((r["doc_id"], *(r[c] for c in columns), None) for r in rows) == Counter((k, *made(t)) for k, t in texts)
    assert all(r["caption"] == ("document" if r["doc_id"] is None else f"document {r['doc_id']}") for r in rows)


def test_quality_rules_query(spark, odd, texts):
    rows = registry.QUERIES["op10_quality_rules"](spark, odd).collect()

    def base(text):
        ws, text = words(text), text or ""
        windows = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        repeat = len({i for k in range(len(ws) - 4) if windows[tuple(ws[k : k + 5])] > 1 for i in range(k, k + 5)})
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(ws) < 10 or 100 * repeat > 20 * len(ws)
        return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, failed

    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in rows) == Counter((k, *base(t)) for k, t in texts)
    assert not any(r["kept"] and r["base_failed"] for r in rows) and sum(r["kept"] for r in rows) > len(rows) / 2
    verdict = {}
    for r in rows:
        assert verdict.setdefault(tuple(r[c] for c in columns) + (r["anomaly"],), r["kept"]) == r["kept"]


def test_mix_query(spark, odd, texts):
    rows = registry.QUERIES["op2_mix_sources"](spark, odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((k, len(words(t))) for k, t in texts)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows) and abs(sum(r["taken"] for r in rows) / sum(r["size"] for r in rows) - 1) < 0.1


def keys(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_pipeline_stages(spark, odd):
    """Each stage by brute force on what the one before kept; all of them lose no row but those that they should."""
    docs, taken = spark.read.parquet(f"{odd}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES:
        out = stage(apply(spark, docs, odd), f"test-{name}")
        taken[name] = docs.collect(), out.collect()
        if name != "sentence_pieces":
            assert out.columns == corpus_pipeline.COLUMNS
        docs = out

    before, after = taken["toxicity"]
    whole = spark.read.parquet(f"{odd}/documents.parquet")
    scores = toxicity.score_toxicity(whole, toxicity.train_on_labels(whole, spark.read.parquet(f"{odd}/labels.parquet")), ["doc_id", "text"]).collect()
    assert keys(after) == keys(r for r in scores if r["score"] < 0.5) and len(after) > 0.8 * len(before)

    before, after = taken["line_dedup"]
    assert len(before) == len(after) and [r["n_chars"] for r in after] == [len(r["text"] or "") for r in after]
    # Rows equal in id and text are one document; blank lines aside, the rest is brute force.
    order = sorted({((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in before})
    single = [k for k, _ in order]
    named = {(k, t): n for n, (k, t) in enumerate(order)}
    brute = brute_runs({n: t for (_, t), n in named.items()})
    lines = lambda t: "\n".join(x for x in (t or "").split("\n") if WORD.search(x))
    wanted = Counter((r["doc_id"], brute[named[(r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or ""]]) for r in before if single.count((r["doc_id"] is not None, r["doc_id"] or 0)) == 1)
    got = Counter((r["doc_id"], lines(r["text"])) for r in after if single.count((r["doc_id"] is not None, r["doc_id"] or 0)) == 1)
    assert got == wanted

    before, after = taken["simhash"]
    sets = [frozenset(grams_of(r["text"])) for r in after]
    assert not keys(after) - keys(before) and len(set(sets)) == len(sets)
    alike = lambda a, b: len(a & b) / len(a | b)
    kept = keys(after)
    for r in before:
        own = frozenset(grams_of(r["text"]))
        assert (r["doc_id"], r["text"]) in kept or max(alike(own, s) for s in sets) >= 0.7
    again = corpus_pipeline.simhash(spark, spark.createDataFrame(before, docs_schema(spark, odd)).repartition(5), odd).collect()
    assert sorted(map(str, again)) == sorted(map(str, after))

    before, after = taken["mixing"]
    assert set(keys(after)) <= set(keys(before))
    for r, n in Counter(after).items():
        assert n <= 3 * before.count(r)
    assert abs(sum(len(words(r["text"])) for r in after) / sum(len(words(r["text"])) for r in before) - 1) < 0.2

    before, after = taken["sentence_pieces"]
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in after) == Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in before)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in after)
    assert sorted(map(str, corpus_pipeline.run(spark, odd).collect())) == sorted(map(str, after))


def docs_schema(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet").select(corpus_pipeline.COLUMNS).schema


def test_pipeline_takes_as_often_as_the_mix_says(spark):
    """Rows equal in id and size but not in text or source are told apart."""
    rows = [(1, f"{w} b c", "en", s, 5) for w in "pqr" for s in ("a", "b", "c")] + [(None, "x y z", "en", "a", 5)] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from oriel.llm.mixing import mix_documents
    from oriel.llm.text import row_hashes

    keyed, one, two = row_hashes(table)
    epochs = Counter()
    for r in mix_documents(keyed, keep=(one, two)).collect():
        epochs[r[one], r[two]] += r["epochs"]
    named = {(r[one], r[two]): (r["doc_id"], r["text"], r["source"]) for r in keyed.collect()}
    out = Counter((r["doc_id"], r["text"], r["source"]) for r in corpus_pipeline.mixing(spark, table, "").collect())
    assert out == Counter({named[k]: n for k, n in epochs.items() if n})


def test_pipeline_of_empty_tables(spark, bare):
    assert corpus_pipeline.run(spark, bare).count() == 0
