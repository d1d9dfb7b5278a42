"""Collocations against counting phrases as text, on a small table with nulls, copies and clashing columns."""

import re
from collections import Counter

import pytest

from oriel.llm import collocations, text

ROWS = [(k, "Strong tea, strong tea and strong TEA! the big red dog\nthe big red dog ran.", "en", "x") for k in range(12)]
ROWS += [(k, " ".join(f"w{(k * j) % 7}" for j in range(60)), None, "y") for k in range(12)]
ROWS += [(None, None, "en", "x"), (1, "", None, None), (1, " \t..\n,", "fr", "x"), (2, "einzig", "", "x"), (3, "a b a b a b a b " * 30, "de", "z")]
COLUMNS = "doc_id long, text string, lang string, word string, id long, left long, names string, rank int"


def brute(rows, least, most):
    counts, words = Counter(), Counter()
    for _, body, lang, _ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in body or "")
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            words[lang] += len(ws)
            counts.update((lang, tuple(ws[i : i + k])) for k in range(1, 5) for i in range(len(ws) - k + 1))
    out = {}
    for (lang, ws), a in counts.items():
        if len(ws) < 2 or a < least:
            continue
        if any(100 * f >= 80 * a for (other, v), f in counts.items() if other == lang and f >= least and len(v) > len(ws) and any(v[i : i + len(ws)] == ws for i in range(len(v)))):
            continue
        cuts = [(2_000_000 * a // (counts[lang, ws[:k]] + counts[lang, ws[k:]]), k, counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return {(lang, rank, p.decode(), -a, left, right, words[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:most], 1)}


@pytest.mark.parametrize("least, most", [(5, 2000), (24, 3)])
def test_collocations(spark, least, most):
    docs = spark.createDataFrame([(*r[:3], "w", 1, 2, "n", 3) for r in ROWS], COLUMNS).repartition(3)
    found = {tuple(r) for r in collocations.collocations(docs, least, most).collect()}
    assert found == brute(ROWS, least, most) and found
    assert collocations.collocations(docs.where("false"), least, most).count() == 0


def test_shared_names_are_found(spark, monkeypatch):
    words = spark.createDataFrame([("en", f"w{k}") for k in range(40)], "lang string, word string")
    real = collocations._named
    monkeypatch.setattr(collocations, "_named", lambda word, seed, mask: real(word, seed, mask) % (8 if seed == 0 else 1 << 40))
    assert words.select(collocations.word_names(words)("word")).distinct().count() == 40


def test_filter_keeps_all_frequent_names(spark, monkeypatch):
    monkeypatch.setattr(text, "MOST_BITS", 128)
    names = spark.range(300).selectExpr("id * 7 as a", "id as b")
    rows = spark.range(3000).selectExpr("id * 7 as a", "id as b")
    kept = text.maybe_among(rows, text.key_filter(names, "a", "b"), "a", "b")
    assert kept.columns == ["a", "b"] and kept.where("b < 300").count() == 300


def test_texts_are_split_once_and_words_named_once(spark, monkeypatch):
    odd = "A\tB  c\x0bd\x0ce\rf\n\n \t g.h,i;j:k!l?m\xa0n\x1fÄB  Z \t"
    docs = spark.createDataFrame([(odd, "en"), (None, "en"), (" \t. ", None)], "text string, lang string")
    pieces = collocations.pieces_of(docs)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in odd)
    assert [r["words"] for r in pieces.collect()] == [ws for p in re.split(r"[.,;:!?\n-\r]", low) if (ws := [w for w in re.split(r"[ \t]+", p) if w])]
    assert pieces._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    labels, real = [], collocations.stage
    monkeypatch.setattr(collocations, "stage", lambda df, label: labels.append((label, "xxhash64" in df._jdf.queryExecution().optimizedPlan().toString() and "transform(" in df._jdf.queryExecution().optimizedPlan().toString())) or real(df, label))
    collocations.collocations(docs, 1).count()
    assert [label for label, hashed in labels if hashed] == ["names"]
