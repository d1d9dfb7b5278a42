"""Sharding by a hypergeometric communication matrix.

A uniform shuffle into shards of exact sizes: the rows lie in blocks, a matrix says how many
rows of each block go to each shard, each block is permuted and cut by its row of the matrix,
the rows change places, and each shard is permuted again. The matrix has the law of the
counts of a uniform permutation: the shards' sizes are split between the two halves of the
blocks by hypergeometric draws, then between the halves of each half, down to single blocks.

A draw is made by inversion: weights relative to the mode follow from the ratio of neighbouring
probabilities, out to eight standard deviations, so no factorials of large numbers are needed.
All of it is SQL; the matrix is a table of one row a block and never leaves the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.llm.text import fresh
from oriel.session import stage
from oriel.sources import read_table

ROWS_PER_BLOCK, MOST_BLOCKS = 4096, 4096
#: Parts of a shard, cut by the leading bits of the second permutation's keys.
PARTS_BITS = 10


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates value once and uses it as name in body."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for the number of marked ones among `drawn` of `total`, of which `marked` are marked, by inversion of `uniform`."""
    ratio = "(cast(q.marked - {k} as double) * (q.drawn - {k}) / (({k} + 1D) * (q.total - q.marked - q.drawn + {k} + 1)))"
    up, down = ratio.format(k="k"), "(1D / " + ratio.format(k="(k - 1)") + ")"
    walk = "aggregate({range}, named_struct('w', 1D, 'sum', 0D), (s, k) -> named_struct('w', s.w * {step}, 'sum', s.sum + s.w * {step}))"
    above = f"if(q.hi > q.mode, {walk.format(range='sequence(q.mode, q.hi - 1)', step=up)}, named_struct('w', 1D, 'sum', 0D))"
    below = f"if(q.lo < q.mode, {walk.format(range='sequence(q.mode, q.lo + 1, -1L)', step=down)}, named_struct('w', 1D, 'sum', 0D))"
    climb = f"aggregate(sequence(q.lo, q.hi), named_struct('w', e.first, 'left', e.goal, 'at', q.hi, 'done', false), (s, k) -> if(s.done, s, named_struct('w', if(k < q.hi, s.w * {up}, 0D), 'left', s.left - s.w, 'at', k, 'done', s.left <= s.w)), s -> s.at)"
    ends = _let("b", below, _let("a", above, f"named_struct('first', b.w, 'goal', {uniform} * (1D + a.sum + b.sum))"))
    span = "cast(8 * sqrt(greatest(0D, cast(p.drawn as double) * p.marked / p.total * (p.total - p.marked) / p.total * (p.total - p.drawn) / greatest(1, p.total - 1))) + 12 as bigint)"
    mode = "cast(floor((p.drawn + 1D) * (p.marked + 1) / (p.total + 2D)) as bigint)"
    least, most = "greatest(0L, p.drawn + p.marked - p.total)", "least(p.drawn, p.marked)"
    bounds = f"named_struct('total', p.total, 'marked', p.marked, 'drawn', p.drawn, 'mode', m, 'lo', greatest({least}, m - w), 'hi', least({most}, m + w))"
    draw = _let("m", f"least(greatest({mode}, {least}), {most})", _let("w", span, _let("q", bounds, _let("e", ends, climb))))
    given = f"named_struct('total', cast({total} as bigint), 'marked', cast({marked} as bigint), 'drawn', cast({drawn} as bigint))"
    return _let("p", given, f"if(p.total = 0 or p.marked = 0 or p.drawn = 0, 0L, {draw})")


def communication_matrix(sizes: DataFrame, blocks: int, shards: int, seed: int) -> DataFrame:
    """Rows (block, counts): how many rows of a block go to each shard, from rows (block, n). blocks: a power of two.

    A block that isn't in sizes has no rows. Shard sizes differ by one at most, the larger ones first.
    """
    levels = blocks.bit_length() - 1
    listed = sizes.agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("m")).selectExpr(f"transform(sequence(0, {blocks - 1}), b -> coalesce(m[b], 0L)) as n")
    nodes = listed.selectExpr("0 as block", "n", "aggregate(n, 0L, (a, x) -> a + x) as total").selectExpr("block", "n", f"transform(sequence(0, {shards - 1}), s -> total div {shards} + if(s < total % {shards}, 1L, 0L)) as counts")
    for level in range(levels):
        width = blocks >> level
        half = width // 2
        uniform = f"((shiftrightunsigned(xxhash64({seed}, {level}, block, i), 11) + 0.5D) / {float(1 << 53):.1f}D)"
        pick = hypergeometric("s.total", "counts[i]", "s.drawn", uniform)
        fold = _let("k", pick, "named_struct('drawn', s.drawn - k, 'total', s.total - counts[i], 'out', concat(s.out, array(k)))")
        left = f"aggregate(sequence(0, {shards - 1}), named_struct('drawn', aggregate(slice(n, 1, {half}), 0L, (a, x) -> a + x), 'total', aggregate(n, 0L, (a, x) -> a + x), 'out', cast(array() as array<bigint>)), (s, i) -> {fold}, s -> s.out)"
        both = f"flatten(transform(array({left}), c -> array(named_struct('block', block, 'n', slice(n, 1, {half}), 'counts', c), named_struct('block', block + {half}, 'n', slice(n, {half + 1}, {half}), 'counts', zip_with(counts, c, (x, y) -> x - y)))))"
        nodes = nodes.selectExpr(f"inline({both})")
        if level == 7:  # from here on the halves are split side by side
            nodes = nodes.repartition("block")
    return nodes.select("block", "counts")


def shuffle_into_shards(rows: DataFrame, keys: list[str], shards: int, seed: int = 11) -> DataFrame:
    """rows with shard and slot: shard sizes at most one apart, slots gapless from 0, all orders alike likely.

    keys: columns that tell rows apart; rows equal in all of them may change places. The same
    rows, shards and seed give the same result however the rows are partitioned. Columns shard
    and slot of rows are replaced, so keys may not name them; all others stay. An empty table gives no rows; fewer rows than shards leave the last shards empty.
    """
    def order(salt: int) -> Column:
        return F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(k) for k in keys])

    rows = stage(rows.drop("shard", "slot"), "shard-rows")
    first, second, block, part, start, rank, n, ends = (fresh(rows, c) for c in ("first", "second", "block", "part", "start", "rank", "n", "ends"))
    wanted = max(1, min(MOST_BLOCKS, math.ceil(rows.count() / ROWS_PER_BLOCK)))
    blocks = 1 << (wanted - 1).bit_length()
    dealt = rows.withColumn(first, order(1)).withColumn(block, F.pmod(order(2), F.lit(blocks)).cast("int"))
    matrix = communication_matrix(dealt.groupBy(F.col(block).alias("block")).agg(F.count("*").alias("n")), blocks, shards, seed)
    local = Window.partitionBy(block).orderBy(first, *keys)
    upto = F.expr("transform(sequence(1, size(counts)), i -> aggregate(slice(counts, 1, i), 0L, (a, x) -> a + x))")
    sent = dealt.join(matrix.select(F.col("block").alias(block), upto.alias(ends)), block).withColumn(rank, F.row_number().over(local) - 1).withColumn("shard", F.expr(f"cast(size(filter(`{ends}`, e -> e <= `{rank}`)) as int)"))
    sent = sent.withColumn(second, order(3)).withColumn(part, F.shiftright(second, 64 - PARTS_BITS).cast("int"))
    sent = stage(sent.drop(first, block, ends, rank), "shard-sent")
    parts = sent.groupBy("shard", part).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", part).orderBy(second, *keys)
    placed = sent.join(starts, ["shard", part]).withColumn("slot", (F.col(start) + F.row_number().over(inside) - 1).cast("long"))
    return placed.select(*rows.columns, "shard", "slot")


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards. A null text has size 1 and the CRC of no bytes, 0."""
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"], 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
