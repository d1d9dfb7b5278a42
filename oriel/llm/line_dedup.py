"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that have a word (blank lines stay where they are). A
repeated run is a run of lines that also starts at an earlier place, in this document or
another; it counts with `min_words` words or `max_lines` lines. All lines of such runs go.

1. A window is the shortest run of lines from a line on that counts. Of every window the least
   line hash, the rightmost of equals, is selected as a fingerprint. Windows depend on their
   lines alone, so both copies of a repeated run select the same lines, and every run that
   counts holds a selected line.
2. Only selected lines are joined by their hashes: those that occur once are done with.
3. From a line that is selected in two places or more the match goes on line by line, to the
   left and to the right, until it counts. Of a run that counts, the shortest end that counts
   has at most `max_lines` lines, so this is as far as one fingerprint has to reach: each of
   the runs of up to `max_lines` lines around it is looked up at its earliest place, and what
   lies further belongs to the next fingerprint. So the exact ends of every repeated run are
   found, whichever earlier place each part of it is from, without comparing pairs of places.
4. Lines of a run with an earlier place are deleted. "Earlier" goes by doc_id (null first),
   then the text's hash, then the line.

Only hashes and positions are shuffled for this; runs are counted and reduced to their first
place by partial aggregates, and a run or line that a thousandth of all have is joined where it
lies. The texts move once, for the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.text import WORD, fresh, join_spread
from oriel.session import stage
from oriel.sources import read_table

MIN_WORDS, MAX_LINES = 50, 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, doc_hash, ls) from rows (doc_id, text): structs (h, g, n) of the lines with a word, two hashes and the number of words; no rows for texts without words."""
    one = lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), F.regexp_count(x, F.lit(WORD)).alias("n"))
    ls = F.filter(F.transform(_lines(F.col("text")), one), lambda x: x["n"] > 0)
    return docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), ls.alias("ls")).where(F.size("ls") > 0)


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """Rows (doc_id, doc_hash, place, mark): the selected lines of each document, by place among its lines with a word, and their hashes."""
    line = lambda k, f: f"get(ls, s + {k}).{f}"
    words = lambda k: " + ".join(line(j, "n") for j in range(k + 1))  # noqa: E731  null past the end
    length = "case " + " ".join(f"when {words(k)} {f'>= {min_words}' if k + 1 < max_lines else 'is not null'} then {k + 1}" for k in range(max_lines)) + " end"
    least = "least(" + ", ".join(f"if(w > {k}, {line(k, 'h')}, null)" for k in range(max_lines)) + ")" if max_lines > 1 else line(0, "h")
    at = "case " + " ".join(f"when w > {k} and {line(k, 'h')} = m then s + {k}" for k in reversed(range(max_lines))) + " end"
    # w: the window's length, null where the document ends before the window is full; m: its least hash.
    chosen = f"array_distinct(array_compact(transform(sequence(0, size(ls) - 1), s -> transform(array({length}), w -> transform(array({least}), m -> {at})[0])[0])))"
    return lines.selectExpr("doc_id", "doc_hash", f"inline(transform({chosen}, s -> named_struct('place', s, 'mark', ls[s].h)))")


def runs_around(lines: DataFrame, places: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """Rows (doc_id, doc_hash, start, length, a, b): the runs that count and have at most max_lines lines around the places (doc_id, doc_hash, places) of each document; a, b: hashes of their lines."""
    shapes = ", ".join(f"named_struct('o', {o}, 'm', {m})" for m in range(1, max_lines + 1) for o in range(m))
    inside = "r.start >= 0 and r.start + r.length <= size(ls)"
    counts = f"(r.length = {max_lines} or aggregate(slice(ls, r.start + 1, r.length), 0, (t, x) -> t + x.n) >= {min_words})"
    shaped = f"flatten(transform(places, p -> transform(array({shapes}), z -> named_struct('start', p - z.o, 'length', z.m))))"
    kept = f"array_distinct(filter({shaped}, r -> if({inside}, {counts}, false)))"
    both = lines.alias("l").join(places.alias("p"), F.col("l.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("l.doc_hash") == F.col("p.doc_hash"))).select("l.doc_id", "l.doc_hash", "ls", "places")
    hashes = "'a', xxhash64(r.length, transform(slice(ls, r.start + 1, r.length), x -> x.h)), 'b', xxhash64(5, r.length, transform(slice(ls, r.start + 1, r.length), x -> x.g))"
    return both.selectExpr("doc_id", "doc_hash", f"inline(transform({kept}, r -> named_struct('start', r.start, 'length', r.length, {hashes})))")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """Rows (doc_id, doc_hash, gone) from rows (doc_id, text): places among its lines with a word that lie in a run with an earlier place."""
    lines = stage(hashed_lines(docs), "hashed-lines")
    marks = stage(fingerprints(lines, min_words, max_lines), "fingerprints")
    shared = marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
    places = join_spread(marks, shared, ["mark"], "n", marks.count()).groupBy("doc_id", "doc_hash").agg(F.collect_set("place").alias("places"))
    runs = stage(runs_around(lines, places, min_words, max_lines), "runs")
    place = F.struct("doc_id", "doc_hash", "start")
    first = runs.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where(F.col("first") != F.col("last")).drop("last")
    later = join_spread(runs, first, ["a", "b"], "n", runs.count()).where(place != F.col("first"))
    return later.groupBy("doc_id", "doc_hash").agg(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(start, start + length - 1)")))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, max_lines: int = MAX_LINES) -> DataFrame:
    """docs with text_col rewritten, and n_lines and n_removed (lines with a word; long).

    Deletes every line of a run of lines that counts and occurs before. Rows equal in id and
    text are one document: they get the same result and don't repeat each other. A null text
    stays null and has no lines; an empty text stays empty; a document whose lines all go
    becomes its blank lines or "". A null id is one like others, and comes first. The columns
    n_lines and n_removed of docs itself are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    text = F.coalesce(docs[text_col], F.lit(""))
    found = repeated_lines(docs.select(docs[id_col].alias("doc_id"), text.alias("text")), min_words, max_lines)
    own, other, gone, split, lines = (fresh(docs, x) for x in ("_id", "_hash", "_gone", "_split", "_worded"))
    found = found.select(F.col("doc_id").alias(own), F.col("doc_hash").alias(other), F.col("gone").alias(gone))
    out = docs.join(found, docs[id_col].eqNullSafe(found[own]) & (F.xxhash64(text) == found[other]), "left").withColumn(split, _lines(docs[text_col]))
    worded = F.expr(f"filter(sequence(0, size(`{split}`) - 1), i -> regexp_like(`{split}`[i], r'{WORD}'))")
    left = F.expr(f"array_join(transform(array_except(sequence(0, size(`{split}`) - 1), transform(`{gone}`, k -> `{lines}`[k])), i -> `{split}`[i]), '\n')")
    kept = out.withColumn(lines, worded).withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_removed", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
    return kept.withColumn(text_col, F.when(F.col(gone).isNull(), out[text_col]).otherwise(left)).drop(own, other, gone, split, lines)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() of all documents; nulls, empty texts and repeated rows as there."""
    return dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Brute force: all pairs of equal lines, chained along diagonals into maximal common runs.
OP1_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM w WHERE n > 0),
pairs AS (SELECT a.doc_id, a.pos, a.i, a.n, b.doc_id AS other, a.i - b.i AS diagonal
          FROM l a JOIN l b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.i < a.i))),
chained AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY i) AS chain FROM pairs),
sized AS (SELECT doc_id, pos, count(*) OVER run AS n_run, sum(n) OVER run AS words FROM chained WINDOW run AS (PARTITION BY doc_id, other, diagonal, chain)),
gone AS (SELECT DISTINCT doc_id, pos FROM sized WHERE n_run >= 3 OR words >= 50),
kept AS (SELECT w.*, gone.pos IS NOT NULL AS removed FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.pos = w.pos)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text, s.n_lines, s.n_removed
FROM documents d JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed) AS text,
         CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE removed) AS BIGINT) AS n_removed
  FROM kept GROUP BY doc_id) s ON s.doc_id = d.doc_id
"""
