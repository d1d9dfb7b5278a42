"""The corpus pipeline: stages that each take what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.line_dedup import dedup_lines
from oriel.llm.mixing import mix_documents
from oriel.llm.pieces import encode_texts
from oriel.llm.simhash import drop_near_copies
from oriel.llm.text import row_hashes
from oriel.llm.toxicity import score_toxicity, train_on_labels
from oriel.session import stage
from oriel.sources import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5, by a classifier fitted on labelled documents of the input."""
    scored = score_toxicity(docs, train_on_labels(docs, read_table(spark, sf_dir, "labels")), COLUMNS)
    return scored.where("score < 0.5").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that occur before; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix takes it; wholly equal rows together as often as it takes all of them."""
    keyed, one, two = row_hashes(docs)
    times = mix_documents(keyed, keep=(one, two)).groupBy(one, two).agg(F.sum("epochs").alias("_times")).where("_times > 0")
    taken = keyed.dropDuplicates([one, two]).join(times, [one, two])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).select(COLUMNS)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of the pieces of each document that the mix takes."""
    return encode_texts(docs, ["doc_id", "source"])


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash", simhash),
    ("mixing", mixing),
    ("sentence_pieces", sentence_pieces),
]

#: SQL can't express the stages (a trained classifier, Hamming links, piece merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
