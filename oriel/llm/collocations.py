"""Collocations by hierarchical pair naming: phrases of two to four words that occur more often than their parts explain.

A phrase of k words is named by the pair of names of its first and its last k - 1 words, so a
name's two parents are all that cuts and subsumption need, and no phrase is ever compared as text.

- Words: a name is a hash of language and word. Names are tried with one seed after another
  until no two words of the corpus share one, so they stand for the words exactly.
- Pairs: adjacent names are counted; frequent pairs get an id from the table of all of them.
- Three and four words: windows whose both parts pass the filter below are counted under the
  names of their words; the frequent ones get an id from the ids of their two parts, pairs for
  three words, threes for four. A phrase that is frequent has frequent parts, so nothing is
  lost, and no window is joined with a table.

Windows are pre-aggregated in the tasks, and before they are shuffled a filter of fixed size drops
most that can't be frequent: a table of bits of the frequent names' hashes (2^26 of them,
2^20 rows of 64, at most), which is broadcast. It never drops a frequent one; the joins after it
are exact. Where there are many more frequent names than bits it passes more, not less.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.llm.text import key_filter, maybe_among
from oriel.session import release, stage
from oriel.sources import read_table

#: Ends of pieces, besides the newline.
PIECE_ENDS = ".,;:!?\x0b\x0c\r"
#: Least occurrences of a phrase; percent of them from which a longer phrase stands for it; phrases of a language that are returned.
LEAST, SUBSUMED, MOST = 30, 80, 2000
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, words): the pieces with a word, as arrays of lower-case words (A-Z alone are changed)."""
    # One end and one space are left, so that texts are split without a regular expression.
    plain = F.translate(docs[text_col], UPPER + PIECE_ENDS + "\t", LOWER + "\n" * len(PIECE_ENDS) + " ")
    pieces = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), F.explode(F.split(plain, "\n")).alias("piece"))
    # The filter looks at the piece, as one on its words would split it twice.
    return pieces.where(F.trim("piece") != "").select("lang", F.array_remove(F.split("piece", " "), "").alias("words"))


def word_names(words: DataFrame) -> Callable[[str | Column], Column]:
    """How words (of the column lang) are named: a hash of as many bits as the number of words asks for, with the first seed under which no two rows (lang, word) share one.

    Each try is one pass over the distinct words; with four bits more than twice the number's, one in 16 fails.
    """
    mask, seed = (1 << min(63, 2 * words.count().bit_length() + 4)) - 1, 0
    while not words.groupBy(_named("word", seed, mask).alias("name")).count().where("count > 1").isEmpty():
        seed += 1
    return lambda word: _named(word, seed, mask)


def _named(word: str | Column, seed: int, mask: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", word).bitwiseAND(F.lit(mask))


def _counted(rows: DataFrame, left: str, right: str, least: int, label: str) -> DataFrame:
    """Rows (id, left, right, f) of the frequent pairs, staged, so that their ids stay."""
    found = rows.groupBy(F.col(left).alias("left"), F.col(right).alias("right")).agg(F.count("*").alias("f")).where(F.col("f") >= least)
    return stage(found.withColumn("id", F.monotonically_increasing_id()), label)


def _join_name(rows: DataFrame, names: DataFrame, left: str, right: str, out: str) -> DataFrame:
    own = names.select(F.col("left").alias(left), F.col("right").alias(right), F.col("id").alias(out))
    return rows.join(own, [left, right])


def named_phrases(pieces: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, list[DataFrame], list[DataFrame]]:
    """All words (lang, word, f), the frequent ones with their names, frequent phrases of 2, 3 and 4 words as (id, left, right, f), and tables to release.

    left and right are names of words for pairs, else ids of the level below. pieces is staged, and released once its words have names.
    """
    words = stage(pieces.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("f")), "words")
    name = word_names(words)
    frequent = words.where(F.col("f") >= least).select("lang", "word", "f", name("word").alias("id"))
    word_marks = key_filter(frequent, "id")

    # Staged, as all levels read the names; the words themselves are no longer needed.
    named = stage(pieces.where(F.size("words") > 1).select(F.transform("words", name).alias("names")), "names")
    release(pieces)
    at = named.select("names", F.posexplode("names").alias("pos", "w1")).withColumn("w2", F.get("names", F.col("pos") + 1)).where("w2 is not null")
    both = reduce(lambda rows, c: maybe_among(rows, word_marks, c), ("w1", "w2"), at.select("w1", "w2"))
    pairs = _counted(both, "w1", "w2", least, "pairs")

    # Longer windows are counted under the names of their words, and only the frequent ones are named by the level below.
    at = at.withColumn("w3", F.get("names", F.col("pos") + 2)).where("w3 is not null")
    pair_marks = key_filter(pairs, "left", "right")
    wide = maybe_among(maybe_among(at.select("w1", "w2", "w3"), pair_marks, "w1", "w2"), pair_marks, "w2", "w3")
    threes = wide.groupBy("w1", "w2", "w3").agg(F.count("*").alias("f")).where(F.col("f") >= least)
    named_threes = _join_name(_join_name(threes, pairs, "w1", "w2", "left"), pairs, "w2", "w3", "right")
    triples = stage(named_threes.withColumn("id", F.monotonically_increasing_id()), "triples")

    marks = key_filter(triples, "w1", "w2", "w3")
    wide = at.select("w1", "w2", "w3", F.get("names", F.col("pos") + 3).alias("w4")).where("w4 is not null")
    wide = maybe_among(maybe_among(wide, marks, "w1", "w2", "w3"), marks, "w2", "w3", "w4")
    found = wide.groupBy("w1", "w2", "w3", "w4").agg(F.count("*").alias("f")).where(F.col("f") >= least)
    first = triples.select("w1", "w2", "w3", F.col("id").alias("left"))
    last = triples.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("w3").alias("w4"), F.col("id").alias("right"))
    named_fours = found.join(first, ["w1", "w2", "w3"]).join(last, ["w2", "w3", "w4"])
    fours = stage(named_fours.select(F.monotonically_increasing_id().alias("id"), "left", "right", "f"), "fours")
    return words, frequent, [pairs, triples.select("id", "left", "right", "f"), fours], [words, named, pairs, triples, fours]


def _score(a: str, left: str, right: str) -> Column:
    return F.expr(f"(2000000 * cast({a} as decimal(25, 0))) div (cast({left} as decimal(25, 0)) + {right})")


#: Of each level: the parts of every cut, from fields of the left (x) and the right (y) parent.
CUTS = {2: [("x.f", "y.f")], 3: [("x.first", "y.f"), ("x.f", "y.last")], 4: [("x.first", "y.f"), ("x.head", "y.tail"), ("x.f", "y.last")]}


def scored_phrases(frequent: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows (lang, phrase, a, l, r, score) of the candidates that no longer phrase stands for, from the names' parents.

    Of a name's fields, first and last are the counts of its outer words, head and tail those of its parents.
    """
    below = frequent.select("lang", "id", F.col("word").alias("phrase"), "word", "f", F.col("f").alias("first"), F.col("f").alias("last"), F.col("f").alias("head"), F.col("f").alias("tail"))
    out = []
    for k, names in enumerate(levels, 2):
        x, y = below.alias("x"), below.alias("y")
        both = names.alias("n").join(x, F.col("n.left") == F.col("x.id")).join(y, F.col("n.right") == F.col("y.id"))
        cuts = F.array_min(F.array(*[F.struct(_score("n.f", a, b).alias("score"), F.lit(i).alias("k"), F.expr(a).alias("l"), F.expr(b).alias("r")) for i, (a, b) in enumerate(CUTS[k], 1)]))
        below = both.select("x.lang", "n.id", F.concat_ws(" ", "x.phrase", "y.word").alias("phrase"), "y.word", "n.f", "x.first", "y.last", F.col("x.f").alias("head"), F.col("y.f").alias("tail"), cuts.alias("cut"))
        if k - 1 < len(levels):
            longer = levels[k - 1].select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("_f")).groupBy("id").agg(F.max("_f").alias("_f"))
            kept = below.join(longer, "id", "left").where(F.col("_f").isNull() | (100 * F.col("_f").cast("decimal(25, 0)") < SUBSUMED * F.col("f").cast("decimal(25, 0)")))
        else:
            kept = below
        out.append(kept.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score"))
    return reduce(DataFrame.unionByName, out)


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score), all counts long: the first `most` phrases of each language.

    Null texts have no words, a null language counts as `und`, repeated rows count each time.
    Equal scores go by a, then by the phrase. Tables without words give no rows; other columns
    of docs don't matter, whatever their names.
    """
    pieces = stage(pieces_of(docs), "pieces")
    words, frequent, levels, spent = named_phrases(pieces, least)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    scored = scored_phrases(frequent, levels).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("_rank") <= most)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)  # of SALTS * most rows a language
    sums = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = stage(ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(*spent)
    return found


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


#: Every phrase counted as text, cut and compared as text.
OP13_SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
cut AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM cut, range(1, 5) AS t(k) WHERE len(ws) >= k),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1 AND f >= {LEAST}),
halves AS (SELECT *, array_to_string(ws[1:c], ' ') AS one, array_to_string(ws[c + 1:], ' ') AS two FROM candidates, range(1, 4) AS t(c) WHERE c < k),
cuts AS (SELECT h.lang, h.k, h.phrase, h.a, c, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * h.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score FROM halves h JOIN counted x ON x.lang = h.lang AND x.phrase = one JOIN counted y ON y.lang = h.lang AND y.phrase = two),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_parts AS (SELECT lang, a, unnest(list_distinct(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' ')))))) AS phrase FROM candidates),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.most IS NULL OR 100::HUGEINT * o.most < {SUBSUMED}::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang) USING (lang) WHERE rank <= {MOST}"""
