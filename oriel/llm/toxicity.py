"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its lower-case character n-grams. Of those that at least `LEAST_TEXTS`
toxic training texts have, all count whose texts are split between the labels further from
chance than `SURE` standard deviations (the signed root of the log-likelihood ratio). With p and
q an n-gram's smoothed shares of toxic and of other texts, its ratio is log(p) - log(q), and a
logistic regression is fitted on the vectors in which each n-gram of the text holds its ratio.

Scoring adds weight * ratio over a text's n-grams in one pass. N-grams are told apart by 64-bit
keys; a table of 2**18 slots tells first which places of a text can matter.

The fit uses at most `MOST_LABELLED` labelled rows, those with the least hashes of their ids;
of these it counts all n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.text import aside, least_hashed
from oriel.session import stage
from oriel.sources import read_table

GRAMS, SLOT_BITS = (3, 4, 5, 6), 18
#: Bound of the training sample, in rows.
MOST_LABELLED = 10000
#: Toxic texts that an n-gram needs, how far from chance it must be, and the ridge.
LEAST_TEXTS, SURE, RIDGE = 3, 4.0, 1e-4

#: Keys of n-grams in order, their slots, their weights, and the intercept.
Model = tuple[np.ndarray, np.ndarray, np.ndarray, float]


def gram_slots(text: str) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The text's code points, with a space at both ends, and for each width the slot of the n-gram at each place."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    mixed, slots = codes * np.uint32(0x9E3779B1), []
    for width in range(2, GRAMS[-1] + 1):
        if len(codes) < width:
            break
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[width - 1 :] * np.uint32(0x9E3779B1)
        if width in GRAMS:
            slots.append((width, (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - SLOT_BITS)))
    return codes, slots


def gram_keys(text: str, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the text's distinct n-grams, in order, and their slots; with a table of slots, of those in slots that it marks."""
    codes, slots = gram_slots(text)
    keys, places = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for width, slot in slots:
        at = np.arange(len(slot)) if used is None else np.flatnonzero(used[slot])
        key = np.full(len(at), width, np.uint64)
        for k in range(width):
            key = (key ^ codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        keys.append(key)
        places.append(slot[at])
    found, first = np.unique(np.concatenate(keys), return_index=True)
    return found, np.concatenate(places)[first]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with an n-gram, over one batch after another."""
    for batch in batches:
        keys, slots = (np.concatenate(x) for x in zip(*[gram_keys(t.as_py()) for t in batch.column(0)], strict=True)) if batch.num_rows else (np.empty(0, np.uint64), np.empty(0, np.uint32))
        found, first, times = np.unique(keys, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(slots[first].astype(np.int32)), pa.array(times)], ["key", "slot", "times"])


def places_in(text: str, keys: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Places among the sorted keys of the text's n-grams, in order."""
    found = gram_keys(text, used)[0]
    at = np.searchsorted(keys, found)
    at[at == len(keys)] = 0
    return at[keys[at] == found] if len(keys) else at[:0]


def _marks(slots: np.ndarray) -> np.ndarray:
    used = np.zeros(1 << SLOT_BITS, bool)
    used[slots] = True
    return used


def _sets(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots = sent.value
        used = _marks(slots)
        for batch in batches:
            rows = [places_in(text.as_py(), keys, used).astype(np.int32) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), *batch.columns[1:]], ["places", "label", "doc_id"])

    return sets


def _counts(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of each label with each key, over one partition."""
        keys, slots = sent.value
        used, n = _marks(slots), np.zeros((2, len(keys)), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                n[label, places_in(text.as_py(), keys, used)] += 1
        at = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[1][at]), pa.array(n[0][at])], ["at", "yes", "no"])

    return counts


def from_chance(yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> np.ndarray:
    """Root of the log-likelihood ratio of a two by two table: how far from chance the texts with an n-gram are split."""
    total = n_yes + n_no
    g = np.zeros(len(yes))
    for seen, row, column in ((yes, yes + no, n_yes), (no, yes + no, n_no), (n_yes - yes, total - yes - no, n_yes), (n_no - no, total - yes - no, n_no)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(seen > 0, seen * np.log(seen * total / (row * column)), 0.0)
    return np.sqrt(np.maximum(2 * g, 0))


#: Places of the sparse matrix that a step of the fit takes at a time.
AT_ONCE = 1 << 18


def fit_logistic(columns: np.ndarray, sizes: np.ndarray, ratio: np.ndarray, labels: np.ndarray, ridge: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept by accelerated gradient steps, for rows that hold ratio[c] at each of their columns c.

    columns: those of all rows one after another; sizes: how many each row has. ridge weighs half
    the squared norm of the weights against the mean loss; the intercept is free. Beside the
    columns only AT_ONCE places at a time (a longer row at once) are held.
    """
    n, ends = len(labels), np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE)), [n]]))
    parts = [(a, b, columns[ends[a] : ends[b]]) for a, b in pairwise(cuts.tolist())]

    def product(w: np.ndarray) -> np.ndarray:
        held = ratio * w
        return np.concatenate([np.bincount(np.repeat(np.arange(b - a), sizes[a:b]), held[c], b - a) for a, b, c in parts])

    def reverse(g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ratio))
        for a, b, c in parts:
            out += np.bincount(c, np.repeat(g[a:b], sizes[a:b]), len(ratio))
        return ratio * out

    direction = np.ones(len(ratio))
    for _ in range(20):  # the largest curvature
        direction = reverse(product(direction / np.linalg.norm(direction)))
    step = 1 / (np.linalg.norm(direction) / (4 * n) + ridge + 0.25)
    w = ahead = np.zeros(len(ratio))
    b = b_ahead = float(np.log((labels.sum() + 1) / (n - labels.sum() + 1)))
    for k in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(product(ahead) + b_ahead, -500, 500))) - labels
        w_next, b_next = ahead - step * (reverse(off) / n + ridge * ahead), b_ahead - step * off.mean()
        ahead, b_ahead = w_next + k / (k + 3) * (w_next - w), b_next + k / (k + 3) * (b_next - b)
        w, b = w_next, b_next
    return w, b


def fit_toxicity(labelled: DataFrame) -> Model:
    """The model from rows (doc_id, text, label 0 or 1), MOST_LABELLED at most.

    Rows with a null label are left out; a null text is an empty one. With no rows or a single
    label there are no n-grams, and the intercept gives the smoothed share of label 1.
    """
    sample = stage(labelled.where("label is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long").alias("label"), F.col("doc_id").cast("string").alias("doc_id")), "labelled-texts")
    context = sample.sparkSession.sparkContext
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_yes, n_no = totals.get(1, 0), totals.get(0, 0)
    nothing = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0)
    if not n_yes or not n_no:
        return *nothing, float(np.log((n_yes + 1) / (n_no + 1)))
    # N-grams of the sample's toxic texts, so bounded as these are.
    known = sample.where("label = 1").select("text").mapInArrow(_vocabulary, "key long, slot int, times long").groupBy("key").agg(F.first("slot").alias("slot"), F.sum("times").alias("times"))
    known = known.where(F.col("times") >= LEAST_TEXTS).select("key", "slot").toArrow()
    keys, slots = known.column("key").to_numpy().view(np.uint64), known.column("slot").to_numpy()
    order = np.argsort(keys)
    keys, slots = keys[order], slots[order]
    table = sample.mapInArrow(_counts(context.broadcast((keys, slots))), "at long, yes long, no long").groupBy("at").agg(F.sum("yes"), F.sum("no")).toArrow()
    yes, no = np.zeros(len(keys)), np.zeros(len(keys))
    at = table.column(0).to_numpy()
    yes[at], no[at] = table.column(1).to_numpy(), table.column(2).to_numpy()
    del known, table, at, order  # the driver's memory is small
    sure = np.flatnonzero(from_chance(yes, no, n_yes, n_no) >= SURE)
    if not len(sure):
        return *nothing, float(np.log((n_yes + 1) / (n_no + 1)))
    keys, slots = keys[sure], slots[sure]
    ratio = np.log((yes[sure] + 1) / (n_yes + 2)) - np.log((no[sure] + 1) / (n_no + 2))
    # In order of ids, as sums in another order would differ in their last bits.
    chosen = sample.mapInArrow(_sets(context.broadcast((keys, slots))), "places array<int>, label long, doc_id string").toArrow().sort_by("doc_id")
    sets = chosen.column("places").combine_chunks()
    columns, sizes = np.asarray(sets.flatten()), np.diff(np.asarray(sets.offsets))
    w, b = fit_logistic(columns, sizes, ratio, np.asarray(chosen.column("label"), np.float64), RIDGE)
    return keys, slots, w * ratio, b


def _scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slots, weights, intercept = model.value
        used = _marks(slots)
        for batch in batches:
            sums = np.array([intercept + weights[places_in(text.as_py() or "", keys, used)].sum() for text in batch.column(batch.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))), pa.float64())], [*batch.schema.names[:-1], "score"])

    return score


def score_toxicity(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of docs and score, from 0 to 1, which replaces a kept one of its name; a null text scores as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept, back = aside(docs, keep, ["score"])
    chosen = docs.select(*kept, docs[text_col].alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "score double"])
    return chosen.mapInArrow(_scorer(sent), schema).select(*back, "score")


def held_out() -> Column:
    """Rows that no classifier here learns from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """fit_toxicity() on the documents with a label that aren't held out; a document with two labels counts once, as toxic if one says so."""
    known = labels.where(~held_out()).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = least_hashed(known, MOST_LABELLED)
    return fit_toxicity(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated row is scored each time; a null id counts as the empty text for the hold-out."""
    docs = read_table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_on_labels(docs, read_table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
