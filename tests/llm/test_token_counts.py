"""Token counts against the tokenizer's library, and the transducers against plain loops."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oriel.llm import token_counts

PATH = public_tokenizers.path(token_counts.FILE)
LETTERS = "abcdelrstvmd''' 019#!.\t\n ÉéßŒœ中文字漢áßΣİſΩⅣ½²①ﬁé가̈́\U0001f600‍"
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|EndOfText|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merger():
    return token_counts.compile_tokenizer(PATH).merger()


def texts():
    rng = random.Random(3)
    out = ["", " ", "'", "it's we'll we're we've 'lx 'r 'v 'rl ''s l'l 'll don'ts 5's #'s 'S", "a" * 5000, "ab" * 3000, "'" * 3000 + "s", "é" * 2500]
    out += ["".join(rng.choice([*LETTERS, *SPECIAL]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    return out + ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x2FFFF)])) for _ in range(20)) for _ in range(700)]


def test_counts_equal_the_library(library, merger, monkeypatch):
    wanted = [len(x.ids) for x in library.encode_batch(texts(), add_special_tokens=False)]
    assert merger.count(texts()).tolist() == wanted
    monkeypatch.setattr(token_counts, "SCANNED", 500)
    monkeypatch.setattr(token_counts, "MOST_STATES", 300)
    monkeypatch.setattr(token_counts, "MOST_WORDS", 100)
    merger.known.clear()
    merger.forget()
    assert merger.count(texts()).tolist() == wanted and len(merger.states) < 400


@pytest.mark.parametrize("chunk", [1, 3, 64, 5000])
def test_word_starts(chunk):
    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    kinds = {"'": token_counts.QUOTE, **dict.fromkeys("stmd", token_counts.ENDS), "r": token_counts.R, "v": token_counts.V, "l": token_counts.L, "e": token_counts.E, " ": token_counts.SPACE, "7": token_counts.DIGIT, "#": token_counts.SIGN, "x": token_counts.LETTER}
    rng = random.Random(chunk)
    for _ in range(40):
        text = "".join(rng.choices("'' strvle7#x", k=rng.randint(0, 300))) + " "
        found = token_counts.word_starts(np.array([kinds[c] for c in text], np.uint8), chunk)
        assert found.tolist() == [m.start() for m in pattern.finditer(text)]


def test_query_form(spark, library):
    rows = [(1, "two words", "x", 1), (None, None, "x", 1), (3, "", "y", 2), (3, "", "y", 2), (4, "word " * 3000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, n_tokens int").repartition(3)
    found = sorted((tuple(r) for r in token_counts.count_tokens(docs, ["doc_id"]).collect()), key=str)
    own = [(k, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, _, _ in rows]
    assert found == sorted(((*r, r[2] > 2048) for r in own), key=str)
    assert token_counts.count_tokens(docs.where("false"), ["doc_id"]).count() == 0


def test_whole_documents(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts.op12_token_counts(spark, "/root/testdata/sf0.01").collect()}
    assert found == wanted


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        token_counts.compile_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
