"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: characters other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars, 0 for null."""
    return F.coalesce(F.length(text) - F.length(F.translate(text, chars, "")), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def aside(docs: DataFrame, keep: list[str], made: list[str]) -> tuple[list[Column], list[Column]]:
    """Columns keep of docs under names of their own, and what gives them their names back; a kept column that an operator makes itself goes, as its own takes its place."""
    names = {f"kept{k}": c for k, c in enumerate(keep) if c.lower() not in {m.lower() for m in made}}
    return [docs[c].alias(n) for n, c in names.items()], [F.col(n).alias(c) for n, c in names.items()]


def row_hashes(rows: DataFrame) -> tuple[DataFrame, str, str]:
    """rows with two more columns, hashes of all others that together tell different rows apart, and their names."""
    named, one, two = [F.col(f"`{c}`") for c in rows.columns], fresh(rows, "_row"), fresh(rows, "_row2")
    return rows.withColumns({one: F.xxhash64(*named), two: F.xxhash64(F.lit(11), *reversed(named))}), one, two


#: Keys with more than this share of all rows are joined by a broadcast; there are fewer of them than its inverse.
HOT_SHARE = 1 / 1000


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """The inner join of rows with table, which has one row a key and in `count` how many of the `total` rows have it.

    No task gets all rows of a hot key: keys with over HOT_SHARE of the rows, 1,000 at most, are
    sent to where the rows lie, and only the others are shuffled. Both tables are read twice.
    """
    hot = F.broadcast(table.where(F.col(count) > total * HOT_SHARE))
    cold = table.where(F.col(count) <= total * HOT_SHARE)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


#: Bits of a filter at most; 64 of them are a row.
MOST_BITS = 1 << 26


def key_filter(table: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """Rows (at, bits) for maybe_among(), and the number of bits: 16 for each row of table, rounded up to a power of two, MOST_BITS at most."""
    size = min(MOST_BITS, 1 << (16 * table.count() + 63).bit_length())
    bit = table.select(F.pmod(F.xxhash64(*keys), F.lit(size)).alias("bit"))
    marks = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    return marks, size


def maybe_among(rows: DataFrame, marks: tuple[DataFrame, int], *keys: str, mark: str | None = None) -> DataFrame:
    """The rows whose keys may be among those of a filter: all that are, and few others; mark: all rows, with a column that says it."""
    table, size = marks
    own = F.broadcast(table.select(F.col("at").alias("_at"), F.col("bits").alias("_bits")))  # MOST_BITS / 64 rows at most
    is_set = F.expr("shiftright(_bits, cast(_bit & 63 as int)) & 1") == 1
    both = rows.withColumn("_bit", F.pmod(F.xxhash64(*keys), F.lit(size))).join(own, F.shiftright("_bit", 6) == F.col("_at"), "left" if mark else "inner")
    return (both.withColumn(mark, F.coalesce(is_set, F.lit(False))) if mark else both.where(is_set)).drop("_bit", "_at", "_bits")


def least_hashed(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """The `most` rows with the least hashes of their ids, in order of hash and id.

    Hashes are spread evenly, so from a count it follows under which hash at least that many
    lie; only rows under it are sorted, and tasks send few rows however many there are. Should
    fewer lie there (ids that repeat), all rows are sorted.
    """
    total, digest = rows.count(), F.xxhash64(id_col)
    if total > 4 * most:
        under = rows.where(digest < -(1 << 63) + int(2 * most / total * (1 << 64)))
        rows = under if under.count() >= most else rows
    return rows.orderBy(digest, id_col).limit(most)
