"""SimHash near-dedup by multi-index hashing.

A fingerprint has one bit for each of a number of hash bits of the text's word shingles: 1 if
the bit is set in over half of them. Fingerprints are cut into segments. Each is filed in a
table under the small Hamming ball of every segment, entries that meet in a table are candidates,
and candidates are verified by their complete distance. How wide the segments are and how far
the balls reach follows from the number of distinct fingerprints, so that buckets stay small.

`CLOSE` is the contract of `op3_simhash_components`: 64 bits, 4 words, 4 bits apart at most. By
the pigeonhole principle no link is lost: the radii plus one add up to five, so two fingerprints
within four bits lie within the radius in one segment at least.

`SIMILAR` finds texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
Such texts differ in some 15 of 100 bits, for which no segment of a useful width is sure to lie
in a small ball. So the number of segments is chosen for the wanted recall, the first bits (the
head) are indexed and compared leniently, then 1,024 bits in all, and the pairs that are left
are decided by their sets of shingles. Only the texts of such pairs take part in that.

Bits only estimate a similarity, and the search within a bucket drops what it has reached though
a stricter check follows, so some links of `SIMILAR` are not found that way. `missed_links`
finds the rest exactly: two sets of similarity t share a shingle among the first (1 - t) * n + 1
of each, in any one order of all shingles (rare ones first). Only shingles that join different
groups of the first search are looked at, so groups of near copies are not expanded into pairs.

Equal fingerprints are one entry, so copies cost nothing. In one bucket, entries are linked by
a search that drops what it has reached: a dense group of b near copies gives some b links, not
b * b / 2 pairs. A bucket of more than `MOST_BUCKET` entries is dealt again by further segments
within it (again without losing a link of `CLOSE`), so that it spreads over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oriel.llm.components import connected_components
from oriel.llm.text import join_spread, key_filter, maybe_among, row_hashes
from oriel.session import stage
from oriel.sources import read_table

SEED = 42
#: Buckets up to this size are compared by shifted arrays, larger ones by the search.
SMALL = 24
#: Buckets above this size are dealt again by further segments.
MOST_BUCKET = 4096

#: (first bit, width, radius); no segment crosses a border between 64-bit words.
Segments = tuple[tuple[int, int, int], ...]


@dataclass(frozen=True)
class Scheme:
    """Shingles (words, and whether repeats count), 64-bit words of the fingerprint, bits apart at most, and the similarity meant."""

    shingle: int
    repeats: bool
    words: int
    most: int
    #: With a similarity the fingerprints give candidates, the sets of shingles decide, and missed_links() finds what is left. recall: the share of pairs of that similarity that become candidates by fingerprints at least, all filters counted.
    similarity: float | None = None
    recall: float = 0.95


CLOSE = Scheme(4, True, 1, 4)
#: Texts of similarity 0.8 are 155 of 1,024 bits apart on average, and under 186 with 199 in 200 draws.
SIMILAR = Scheme(5, False, 16, 185, 0.8)


def ball(width: int, radius: int) -> float:
    """Entries that a segment files on average: a radius of 1 is met by setting bits on one side, of 2 by balls of radius 1 on both."""
    return (1.0, 1 + width / 2, 1.0 + width)[radius]


def exact_segments(n: int, most: int = 4) -> Segments:
    """Segments of one 64-bit word that lose no link within `most` bits, for n distinct fingerprints.

    Of the splits into s segments with radii that add up to most + 1 - s, the one with the least
    work: entries, and comparisons within buckets at a twentieth of an entry each.
    """
    choices = []
    for s in range(max(1, -(-(most + 1) // 3)), most + 2):
        widths = [64 // s + (k >= s - 64 % s) for k in range(s)]
        radii = [(most + 1) // s - 1 + (k < (most + 1) % s) for k in range(s)]
        cost = sum(ball(w, r) * (1 + 0.05 * n * ball(w, r) / 2.0**w) for w, r in zip(widths, radii, strict=True))
        choices.append((cost, tuple((sum(widths[:k]), widths[k], radii[k]) for k in range(s))))
    return min(choices)[1]


def differing(similarity: float) -> float:
    """Share of bits in which fingerprints of two sets of that Jaccard similarity and equal size differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


#: Pairs of the similarity that the head's distance, or that of complete fingerprints, leaves out.
FAR = 1 / 200


def head_segments(n: int, similarity: float, recall: float) -> tuple[int, Segments]:
    """(words of the head, segments) that find a pair of the similarity with at least that probability, for n fingerprints.

    What the segments find is judged twice more by distances, each of which loses a share FAR; so the segments' own share is higher.
    """
    recall = recall / (1 - FAR) ** 2
    p = differing(similarity)
    width, radius = (16, 1) if n < 1 << 20 else (21, 1) if n < 1 << 26 else (32, 2)
    hit = sum(math.comb(width, k) * p**k * (1 - p) ** (width - k) for k in range(radius + 1))
    per_word = 64 // width
    words = -(-math.ceil(math.log(1 - recall) / math.log(1 - hit)) // per_word)
    return words, tuple((64 * w + width * k, width, radius) for w in range(words) for k in range(per_word))


def head_reach(words: int, similarity: float) -> int:
    """Bits of the head that a pair of the similarity differs in at most, but for a share FAR."""
    p, bits = differing(similarity), 64 * words
    return math.ceil(bits * p + NormalDist().inv_cdf(1 - FAR) * math.sqrt(bits * p * (1 - p)))


def count_bits(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set, by row of a two-dimensional array; eight counters to a 64-bit number."""
    rows, n = hashes.shape
    out = np.zeros((rows, 8, 8), np.int64)
    for k in range(0, n, 255 * 32):
        part = hashes[:, k : k + 255 * 32]
        padded = np.zeros((rows, -(-part.shape[1] // 255) * 255), np.uint64)
        padded[:, : part.shape[1]] = part
        for b in range(8):
            lanes = ((padded >> np.uint64(b)) & np.uint64(0x0101010101010101)).reshape(rows, -1, 255).sum(axis=2)
            out[:, :, b] += lanes.view(np.uint8).reshape(rows, -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(rows, 64)


def spread_bits(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hashes themselves and words - 1 further ones of each, one to a row."""
    if words == 1:
        return hashes[None]
    z = hashes[None] + (np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z[0] = hashes
    return z


def shingle_hashes(data: bytes, scheme: Scheme) -> np.ndarray:
    """Of the shingles of a text's UTF-8 bytes, sorted and distinct where repeats don't count; none without words."""
    words = data.lower().split()  # of bytes: A-Z only, and U+0009 to U+000D and the space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < scheme.shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length + 1) - 1
        starts = ends - length
        grams = zip(starts[: len(words) - scheme.shingle + 1].tolist(), ends[scheme.shingle - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in grams), np.uint64, len(words) - scheme.shingle + 1)
    return hashes if scheme.repeats else np.unique(hashes)


def fingerprint(data: bytes, scheme: Scheme = CLOSE) -> np.ndarray:
    """Of a text's UTF-8 bytes, as unsigned words; zeros without words."""
    return print_of(shingle_hashes(data, scheme), scheme)


def set_id(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set of shingles, as short as a shingle's own."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def print_of(hashes: np.ndarray, scheme: Scheme) -> np.ndarray:
    """fingerprint() of the shingles' hashes."""
    ones = np.zeros((scheme.words, 64), np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += count_bits(spread_bits(hashes[k : k + (1 << 16)], scheme.words))
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def words_of(column: pa.Array, words: int) -> np.ndarray:
    """A column of binaries of 8 * words bytes, as a table of unsigned numbers."""
    if not len(column):
        return np.zeros((0, words), np.uint64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64).reshape(-1, words)


def binaries(table: np.ndarray) -> pa.Array:
    """The reverse of words_of()."""
    size = 8 * table.shape[1]
    offsets = np.arange(len(table) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(table))])


def _fingerprints(scheme: Scheme, head: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, named = np.zeros((batch.num_rows, scheme.words), np.uint64), np.zeros((2, batch.num_rows), np.int64)
            for k, x in enumerate(batch.column(batch.num_columns - 1).cast(pa.binary())):
                hashes = shingle_hashes(x.as_py() or b"", scheme)
                found[k] = print_of(hashes, scheme)
                if scheme.similarity is not None:
                    named[:, k] = set_id(hashes), len(hashes)
            more = {"complete": binaries(found)} if head < scheme.words else {}
            more |= {"set": pa.array(named[0]), "size": pa.array(named[1])} if scheme.similarity is not None else {}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], binaries(found[:, :head]), *more.values()], [*batch.schema.names[:-1], "fp", *more])

    return prints


def _file(segments: Segments, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries (bucket, fp): each fingerprint under the balls of its segments."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                fps = words_of(whole.column(0).slice(at, 2000), words)
                for k, (first, width, radius) in enumerate(segments):
                    own = (fps[:, first // 64] >> np.uint64(first % 64)) & np.uint64((1 << width) - 1)
                    keys, rows = [own], [np.arange(len(fps))]
                    for j in range(width if radius else 0):
                        bit = np.uint64(1 << j)
                        here = np.flatnonzero(own & bit == 0) if radius == 1 else rows[0]
                        keys.append(own[here] ^ bit)
                        rows.append(here)
                    bucket = np.concatenate(keys) | np.uint64(k << 40)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), binaries(fps[np.concatenate(rows)])], ["bucket", "fp"])

    return filed


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def link_bucket(entries: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect the distinct entries of one bucket as all pairs within `most` bits would.

    Each group is also linked to its member nearest to the group's majority of bits, as links
    to a text that others derive from pass a stricter check best.
    """
    rest, found = np.unique(entries, axis=0), []
    while len(rest):
        group, waiting, rest = [rest[:1]], [rest[0]], rest[1:]
        while waiting and len(rest):
            reached = waiting.pop()
            near = apart(rest, reached) <= most
            if near.any():
                new = rest[near]
                found.append((np.broadcast_to(reached, new.shape), new))
                group.append(new)
                waiting.extend(new)
                rest = rest[~near]
        if len(group) > 1:
            members = np.concatenate(group)
            middle = np.packbits(2 * count_bits(np.ascontiguousarray(members.T)) > len(members), axis=1, bitorder="little").view(np.uint64)[:, 0]
            hub = members[np.argmin(apart(members, middle))]
            off = apart(members, hub)
            near = members[(off > 0) & (off <= most)]
            found.append((np.broadcast_to(hub, near.shape), near))
    return found


def _link(bucket: np.ndarray, fp: np.ndarray, most: int, deal: bool) -> pa.RecordBatch:
    """Rows (a, b, again) within buckets, which stand together: links, or entries (a) to be dealt again under `again`."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, len(bucket)]
    large, links, again = ends - starts > SMALL, [], []
    for a, b in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        if deal and b - a > MOST_BUCKET:
            base = bucket[a : a + 1].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) << np.uint64(17)
            # Within `most` bits, two agree in one of most + 1 further segments of a 64-bit word.
            for k in range(most + 1):
                first, last = 64 * k // (most + 1), 64 * (k + 1) // (most + 1)
                key = (fp[a:b, 0] >> np.uint64(first)) & np.uint64((1 << (last - first)) - 1)
                again.append((fp[a:b], (key << np.uint64(3) | np.uint64(k)) ^ base))
        else:
            links += link_bucket(fp[a:b], most)
    small = ~np.repeat(large, ends - starts)
    bucket, fp = bucket[small], fp[small]
    for d in range(1, SMALL):
        at = np.flatnonzero(bucket[d:] == bucket[:-d])
        if not len(at):
            break
        off = apart(fp[at], fp[at + d])
        at = at[(off > 0) & (off <= most)]
        links.append((fp[at], fp[at + d]))
    none = fp[:0]
    one, other = (np.concatenate([x[k] for x in links] + [none]) for k in (0, 1))
    dealt, keys = np.concatenate([x for x, _ in again] + [none]), np.concatenate([k for _, k in again] + [np.empty(0, np.uint64)])
    numbers = pa.array(np.r_[np.zeros(len(one), np.int64), keys.view(np.int64)], mask=np.r_[np.ones(len(one), bool), np.zeros(len(keys), bool)])
    return pa.RecordBatch.from_arrays([binaries(np.concatenate([one, dealt])), binaries(np.concatenate([other, dealt])), numbers], ["a", "b", "again"])


def _links(words: int, most: int, deal: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket may go on in the next batch, so the last one of a batch waits."""
        kept_bucket, kept = [], []
        for batch in batches:
            bucket, fp = batch.column(0).to_numpy(zero_copy_only=False), words_of(batch.column(1), words)
            if not len(bucket):
                continue
            kept_bucket.append(bucket)
            kept.append(fp)
            if bucket[-1] == kept_bucket[0][0]:
                continue
            bucket, fp = np.concatenate(kept_bucket), np.concatenate(kept)
            cut = int(np.searchsorted(bucket, bucket[-1]))
            kept_bucket, kept = [bucket[cut:]], [fp[cut:]]
            yield _link(bucket[:cut], fp[:cut], most, deal)
        if kept:
            yield _link(np.concatenate(kept_bucket), np.concatenate(kept), most, deal)

    return links


def near_links(fingerprints: DataFrame, segments: Segments, words: int, most: int, deal: bool) -> DataFrame:
    """Distinct links (a, b), a before b, of the distinct binaries fp, that connect those which meet in a bucket as all pairs within `most` bits would."""

    def linked(filed: DataFrame, deal: bool) -> DataFrame:
        return filed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(words, most, deal), "a binary, b binary, again long")

    found = stage(linked(fingerprints.select("fp").mapInArrow(_file(segments, words), "bucket long, fp binary"), deal), "links")
    links = found.where("again is null")
    if deal and not found.where("again is not null").isEmpty():
        links = links.union(linked(found.where("again is not null").selectExpr("again as bucket", "a as fp").distinct(), False))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _complete(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = apart(words_of(batch.column(2), words), words_of(batch.column(3), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(off)], ["a", "b", "bits"])

    return distances


def _sets(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_hashes(x.as_py() or b"", scheme).view(np.int64) for x in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], ["fp", "grams"])

    return sets


def alike(links: DataFrame, distinct: DataFrame, named: DataFrame, scheme: Scheme) -> DataFrame:
    """The links (a, b) whose sets of shingles have the scheme's Jaccard similarity at least.

    Of each linked fingerprint (or set, under the same column) the least row's text is read, found in `named` by `row` and `row2`.
    """
    nodes = links.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    owners = distinct.join(nodes, "fp", "left_semi").select("fp", "least.row", "least.row2")
    # Few rows own a linked fingerprint; a filter keeps the other texts from being shuffled.
    owners = stage(owners, "owners")
    near = maybe_among(named.select("row", "row2", "_text"), key_filter(owners, "row", "row2"), "row", "row2")
    texts = near.join(owners, ["row", "row2"]).dropDuplicates(["fp"]).select("fp", "_text")
    sets = stage(texts.mapInArrow(_sets(scheme), f"fp {distinct.schema['fp'].dataType.simpleString()}, grams array<bigint>"), "shingle-sets")
    side = lambda x: sets.select(F.col("fp").alias(x), F.col("grams").alias(f"grams_{x}"))
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    compared = links.join(side("a"), "a").join(side("b"), "b").withColumn("common", common)
    return compared.where(F.col("common") / (F.size("grams_a") + F.size("grams_b") - F.col("common")) >= scheme.similarity).select("a", "b")


#: Texts from which common shingles are learned, and how many of them come last in the order at most. They change the work, never a result.
ORDER_TEXTS, MOST_COMMON = 10_000, 1 << 17
#: Rarer shingles with which a row looks for an earlier meeting of a pair. They change the work, never a result.
NEAR_BEFORE = 64
#: Searches by leaders where buckets hold many groups, and the partners an entry has on average from which they are made.
LEADER_ROUNDS, MANY_PARTNERS = 3, 16


def at_least(similarity: float, size: np.ndarray | int) -> np.ndarray:
    """ceil(similarity * size), safe from rounding."""
    return np.ceil(similarity * size - 1e-6).astype(np.int64)


def _first_shingles(scheme: Scheme, common: np.ndarray, counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (token, set): of each text the shingles of which a similar set has one at least among its own; common ones come last in the order."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                tokens, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for x in batch.column(0).slice(at, 500).cast(pa.binary()):
                    hashes = shingle_hashes(x.as_py() or b"", scheme)
                    name = set_id(hashes)
                    if not len(hashes) or name in seen:
                        continue
                    seen.add(name)
                    if len(common):
                        place = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                        hashes = hashes[np.lexsort((hashes, np.where(common[place] == hashes, counts[place], 0)))]
                    hashes = hashes[: len(hashes) - at_least(scheme.similarity, len(hashes)) + 1]
                    tokens.append(hashes.view(np.int64))
                    names.append(np.full(len(hashes), name))
                if len(seen) > 1 << 17:
                    seen.clear()  # copies further on come again, which costs work alone
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(names))], ["token", "set"])

    return first


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, set) in order, the distinct ones whose token another set has too."""
    token, name, given = np.zeros(0, np.int64), np.zeros(0, np.int64), True
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        tokens, names = np.r_[token, own[0]], np.r_[name, own[1]]
        if not len(tokens):
            continue
        new = np.r_[True, (tokens[1:] != tokens[:-1]) | (names[1:] != names[:-1])]
        tokens, names = tokens[new], names[new]
        same = tokens[1:] == tokens[:-1]
        out = np.r_[False, same] | np.r_[same, False]
        # The last row waits for the next one; it goes on in front of the next batch, given out or not.
        was_given, given = given and len(token) > 0, bool(out[-1]) or (len(tokens) == 1 and given and len(token) > 0)
        if was_given:
            out[0] = False
        token, name = tokens[-1:], names[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(tokens[out]), pa.array(names[out])], ["token", "set"])


def common_shingles(named: DataFrame, rows: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two of some ORDER_TEXTS texts have, the MOST_COMMON most frequent ones at most: their hashes in order, and counts."""
    some = named.where(F.pmod("row", F.lit(max(1, rows // ORDER_TEXTS))) == 0).dropDuplicates(["row", "row2"]).select("row", "_text")
    grams = some.mapInArrow(_sets(scheme), "fp long, grams array<bigint>").select(F.explode("grams").alias("token"))
    found = grams.groupBy("token").count().where("count > 1").orderBy(F.desc("count"), "token").limit(MOST_COMMON).toArrow()
    hashes, counts = (found.column(k).to_numpy().astype(np.int64) for k in (0, 1))
    order = np.argsort(hashes.view(np.uint64))
    return hashes.view(np.uint64)[order], counts[order]


def _needed(similarity: float, size: Column) -> Column:
    """at_least() as a column."""
    return F.ceil(F.lit(similarity) * size - 1e-6)


def _by_holders(crossing: DataFrame) -> DataFrame:
    """crossing with one shingle for all that the same sets have, and in `weight` how many these are."""
    holders = [F.bit_xor(F.xxhash64(F.lit(k), "set")).alias(f"holders{k}") for k in (0, 1)]
    same = crossing.groupBy("token").agg(F.first("n").alias("held"), *holders).groupBy("held", "holders0", "holders1")
    return crossing.join(same.agg(F.min("token").alias("token"), F.count("*").alias("weight")).select("token", "weight"), "token")


def _pairs_across(crossing: DataFrame, similarity: float) -> DataFrame:
    """Rows (a, b) of sets of different groups: all similar ones, and few others; crossing: rows (token, set, size, root, n).

    Of two similar sets take the one whose first shingles end earlier in their order. Those of
    its first shingles that the other has are among the other's first ones too, so all of them
    cross groups. So it shares none of its first shingles that don't cross, nor, at the rarest
    one that both have, any rarer one: what is left (`most`) must suffice for the similarity. A
    shingle that gives a pair must leave enough to one set at least, so only the rows of which
    that can be are joined with all others. A pair meets at the first one that both have, where
    most is left, and not again behind it: shingles that the same sets have count as one, and
    rows carry their NEAR_BEFORE rarer ones (a pair that has none of them in common may meet
    again, which costs work alone). Then the first shingles of both are compared: what is
    common lies among the first of both, or behind the first of the one whose end earlier.
    """
    need = lambda size: _needed(similarity, size)
    own = Window.partitionBy("set")
    order = own.orderBy("n", "token")
    behind = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.collect_list("token").over(order.rowsBetween(-NEAR_BEFORE, -1))
    ranked = _by_holders(crossing).withColumns({"most": need(F.col("size")) - 1 + behind, "before": before})
    fields = F.struct("set", "size", "root", "most", "before")
    one = ranked.where(F.col("most") >= need(F.col("size"))).select("token", fields.alias("x"))
    other = ranked.select("token", fields.alias("y"))
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    common = _needed(similarity / (1 + similarity), small + large)
    once = (F.col("y.most") < common) | (F.col("x.set") < F.col("y.set"))
    first = ~F.arrays_overlap("x.before", "y.before")
    met = one.join(other, "token").where((F.col("x.root") != F.col("y.root")) & (small >= need(large)) & (F.col("x.most") >= common) & once & first)
    pairs = stage(met.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b"), F.greatest(F.lit(1), common - need(large) + 1).alias("least")).distinct(), "pairs-met")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    firsts = crossing.join(nodes, "set", "left_semi").groupBy("set").agg(F.collect_list("token").alias("tokens"))
    side = lambda x: firsts.select(F.col("set").alias(x), F.col("tokens").alias(f"tokens_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= F.col("least")).select("a", "b")


def missed_links(prints: DataFrame, named: DataFrame, links: DataFrame, rows: int, scheme: Scheme) -> DataFrame:
    """links (a, b) of fingerprints, and more, so that all texts of the scheme's similarity are connected.

    Shingles that sets of different groups share give pairs across groups. Where a shingle has
    many groups, its sets are first compared with one of them, which joins what belongs together;
    then the pairs across groups that are left are decided, as _pairs_across() gives them.
    """
    t = scheme.similarity
    nodes = stage(prints.groupBy("set").agg(F.min("fp").alias("print"), F.min("size").alias("size"), F.min(F.struct("row", "row2")).alias("least")), "shingle-set-names")
    filed = named.select("_text").mapInArrow(_first_shingles(scheme, *common_shingles(named, rows, scheme)), "token long, set long")
    shared = stage(filed.repartition("token").sortWithinPartitions("token", "set").mapInArrow(_shared, "token long, set long"), "shared-shingles")
    decided = nodes.select(F.col("set").alias("fp"), "least")
    before = None
    for k in range(LEADER_ROUNDS + 1):
        groups = nodes.join(connected_components(links).withColumnRenamed("node", "print"), "print", "left").select("set", "size", F.coalesce("root", "print").alias("root"))
        rooted = shared.join(groups, "set")
        mixed = rooted.groupBy("token").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.count("*").alias("n")).where("one < other")
        crossing = stage(rooted.join(mixed.select("token", "n"), "token"), "crossing-shingles")
        entries, partners = crossing.agg(F.count("*"), F.sum("n")).first()
        if not entries:
            return links
        # Leaders go on only while they join groups.
        last = k == LEADER_ROUNDS or partners <= MANY_PARTNERS * entries or (before is not None and partners > 0.9 * before)
        before = partners
        if last:
            met = _pairs_across(crossing, t)
        else:
            one = crossing.select("token", F.struct("set", "size", "root").alias("x"))
            other = one.groupBy("token").agg(F.min_by("x", F.xxhash64(F.lit(k), "x.set")).alias("y"))
            alike_sizes = F.least("x.size", "y.size") >= _needed(t, F.greatest("x.size", "y.size"))
            pairs = one.join(other, "token").where((F.col("x.root") != F.col("y.root")) & alike_sizes)
            met = pairs.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()
        close = alike(stage(met, "pairs-across"), decided, named, scheme)
        side = lambda x: nodes.select(F.col("set").alias(x), F.col("print").alias(f"print_{x}"))
        links = stage(links.unionByName(close.join(side("a"), "a").join(side("b"), "b").selectExpr("print_a as a", "print_b as b").where("a != b")), "links-across")
        if last:
            return links


def near_groups(docs: DataFrame, keys: list[str], text: Column, scheme: Scheme) -> DataFrame:
    """Rows (keys, fp, least): a row's fingerprint (its head) and the least struct of keys that links reach, null keys last.

    A scheme with a similarity needs the keys row and row2, which tell rows apart.
    """
    rows = docs.count()
    words, segments = (scheme.words, ()) if scheme.similarity is None else head_segments(rows, scheme.similarity, scheme.recall)
    named = docs.select(*keys, text.alias("_text"))
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1]), "fp binary", *["complete binary"] * (words < scheme.words), *["set long, size long"] * (scheme.similarity is not None)])
    # A table of its own: the fingerprints are read several times.
    prints = stage(named.mapInArrow(_fingerprints(scheme, words), shape), "fingerprints")
    own = F.struct(F.col(keys[0]).isNull().alias("_null"), *keys)
    distinct = stage(prints.groupBy("fp").agg(F.min(own).alias("least"), F.count("*").alias("copies"), *[F.min("complete").alias("complete")] * (words < scheme.words)), "distinct-fingerprints")
    if scheme.similarity is None:
        links = near_links(distinct, exact_segments(distinct.count(), scheme.most), words, scheme.most, True)
    else:
        links = near_links(distinct, segments, words, head_reach(words, scheme.similarity), False)
        side = lambda x: distinct.select(F.col("fp").alias(x), F.col("complete").alias(f"complete_{x}"))
        pairs = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "complete_a", "complete_b")
        close = pairs.mapInArrow(_complete(scheme.words), "a binary, b binary, bits long").where(F.col("bits") <= scheme.most).select("a", "b")
        links = stage(alike(stage(close, "close-pairs"), distinct, named, scheme), "alike-links")
        links = missed_links(prints, named, links, rows, scheme)
    roots = connected_components(links).withColumnRenamed("node", "fp")
    linked = stage(distinct.join(roots, "fp").select("fp", "root", "least", "copies"), "linked-fingerprints")
    first = linked.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    merged = join_spread(linked, first, ["root"], "n", linked.count()).select("fp", "first")
    reached = distinct.select("fp", "least", "copies").join(merged, "fp", "left").select("fp", "copies", F.coalesce("first", "least").alias("least"))
    return join_spread(prints.drop("complete", "set", "size"), stage(reached, "named-fingerprints"), ["fp"], "copies", rows).drop("copies")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = CLOSE) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of docs; fp: the (head of the) fingerprint, 64-bit words of 8 bytes, least significant first.

    component_id: the least doc_id that links reach, the row's own included. Null and empty
    texts have fingerprint zero and link like others; repeated rows share a component; a null
    doc_id counts only where a component has no other. An empty table gives no rows.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    keys = ["doc_id"]
    if scheme.similarity is not None:
        hashed, one, two = row_hashes(rows)
        rows, keys = hashed.withColumnsRenamed({one: "row", two: "row2"}), ["doc_id", "row", "row2"]
    found = near_groups(rows, keys, F.col("text"), scheme)
    return found.select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SIMILAR) -> DataFrame:
    """One row of docs for each group of near copies: the least by id (null last), then by two hashes of all columns.

    Rows are told apart by these hashes, so rows without an id and different rows with one id
    each count. Of wholly equal rows one stays. A null text counts as an empty one, and all
    texts without words are copies of each other. Only columns that Spark can hash may be there.
    """
    keyed, one, two = row_hashes(docs)
    rows = keyed.select(keyed[id_col].alias("doc_id"), keyed[one].alias("row"), keyed[two].alias("row2"), keyed[text_col].alias("text"))
    found = near_groups(rows, ["doc_id", "row", "row2"], F.col("text"), scheme)
    kept = found.where((F.col("least.row") == F.col("row")) & (F.col("least.row2") == F.col("row2"))).select(F.col("row").alias(one), F.col("row2").alias(two)).distinct()
    return keyed.dropDuplicates([one, two]).join(kept, [one, two], "left_semi").drop(one, two)


def op3_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_components() of all documents under the contract's scheme; nulls, copies and empty texts as there."""
    found = near_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.concat(*[F.hex(F.substring("fp", k, 1)) for k in range(8, 0, -1)])).alias("fingerprint"), "component_id")
