"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a target number of words. A target of several times the source's size is
met by complete epochs first; the rest is a weighted sample without replacement: each document
has the key u ** (1 / weight), equal in order to an exponential key scaled by its weight, and
the documents with the largest keys are taken until the words left are used up.

The prefix sums are taken in two levels. Keys fall into fixed bins, (source, bin) sums are
added up over at most `BINS` rows a source, and only rows of one bin are sorted together, so
a source with a third of all documents is spread over `BINS` groups. With e = -log(key), an
exponential draw over the weight, the bins are even in e / (1 + e): for no weight from 0.05 to
1 does a bin hold over a 300th of the documents, while bins even in the key itself would put
most documents of a small weight into the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.llm.text import count_chars, count_words
from oriel.session import stage
from oriel.sources import read_table

BINS = 4096
#: Symbols that lower a document's weight.
NOISE = "#*$%&|<>!"


def quality_weight(text: Column) -> Column:
    """From 0.05 to 1: 1 less ten times the share of noise symbols; empty and null texts have 1."""
    share = count_chars(text, NOISE) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(10.0) * share), F.lit(1.0))


def unit_draw(row_id: Column, seed: str) -> Column:
    """A number in (0, 1) that only the id and the seed decide."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row a source (source, source_size, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn. The targets share the sum
    of all sizes by weight; none exceeds max_epochs times its source, and the excess is shared
    again: target = min(max_epochs * size, level * weight) with the level at which they add up.
    The table has one row a source, and its windows run over these rows alone.
    """
    ranked = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    limits = ranked.withColumn("weight", turn).withColumn("most", F.col("source_size").cast("double") * max_epochs).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = limits.withColumn("try", level).withColumn("free", F.row_number().over(by_ratio))
    found = F.min(F.when(F.col("try") <= F.col("ratio"), F.struct("free", "try"))).over(everything)["try"]
    return levels.withColumn("level", found).select("source", "source_size", F.round(F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))), 6).alias("target"))


def mix(docs: DataFrame, size: Column, weight: Column, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, epochs, taken, keep), one for each row of docs.

    epochs: how many times the mix takes the document; taken: its words in the mix. The sample
    ends where the next document would go further past the target than it now falls short, so
    a source misses its target by at most half of one document. A null source is a source of
    its own; a document without words is taken in complete epochs only and adds nothing; rows
    with the same id share a key and follow each other by size, then by the columns `keep` of
    docs, which must not bear the names above; an empty table gives no rows.
    """
    draws = docs.select(*keep, docs[id_col].alias("doc_id"), docs[source_col].alias("source"), size.cast("long").alias("size"), F.greatest(weight.cast("double"), F.lit(1e-3)).alias("w"))
    keyed = stage(draws.withColumn("key", F.pow(unit_draw(F.col("doc_id"), seed), 1 / F.col("w"))).drop("w").withColumn("e", -F.log(F.greatest("key", F.lit(1e-300)))).withColumn("bin", F.floor(F.col("e") / (1 + F.col("e")) * BINS).cast("int")).drop("e"), "mix-keys")
    targets = source_targets(keyed, weights, max_epochs)
    bins = keyed.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("start", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", "bin", "start", "source_size", "target")
    k, p = keyed.alias("k"), plan.alias("p")
    placed = k.join(p, F.col("k.source").eqNullSafe(F.col("p.source")) & (F.col("k.bin") == F.col("p.bin"))).select(*keep, "doc_id", "k.source", "size", "key", "k.bin", "start", "source_size", "target")
    in_bin = Window.partitionBy("source", "bin").orderBy(F.desc("key"), "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - F.col("full") * F.col("source_size")
    before = F.col("start") + F.coalesce(F.sum("size").over(in_bin), F.lit(0))
    chosen = placed.withColumn("full", full.cast("long")).withColumn("before", before).withColumn("epochs", F.col("full") + ((F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * left)).cast("long"))
    return chosen.select("doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).cast("long").alias("taken"), *keep)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """mix() of a documents table, sized by words and weighted by quality_weight()."""
    return mix(docs, count_words(docs["text"]), quality_weight(docs["text"]), **options)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_documents() of all documents; nulls, repeated rows, ties and empty texts as in mix()."""
    mixed = mix_documents(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u,
         coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 10.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / greatest(length(text), 1)), 1.0::DOUBLE) AS w
  FROM documents),
k AS (SELECT doc_id, source, size, pow(u, 1 / w) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM k GROUP BY source),
l AS (SELECT *, CAST(1 + rank % 3 AS DOUBLE) AS weight, 3 * CAST(source_size AS DOUBLE) AS most, 3 * CAST(source_size AS DOUBLE) / (1 + rank % 3) AS ratio FROM s),
t AS (SELECT *, row_number() OVER (ORDER BY ratio, rank) AS free,
             (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS try FROM l),
v AS (SELECT arg_min(try, free) AS level FROM t WHERE try <= ratio),
g AS (SELECT source, source_size, round(least(most, coalesce(level * weight, most)), 6) AS target FROM t, v),
p AS (SELECT k.*, source_size, target,
             CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_epochs,
             coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, CAST(full_epochs + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - full_epochs * source_size) THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size AS BIGINT) AS taken, epochs FROM e
"""
