"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text is marked (spaces become U+2581, one is put in front) and cut into words: marks and what
follows them up to the next mark. No piece has a mark after another character, and none has a
line end, so pieces never cross these cuts. The distinct words of a batch are sorted, which
lays them out as a depth-first walk of their trie: a word starts with the forward states of the
prefix that it shares with the word before, and only its own ending is computed.

The forward state of a prefix depends on the model. For a unigram model it is the best sum of
scores (Viterbi). For a merge model (BPE, as piece_bpe_32k.model is) best sums would not give
the pieces of the model's own encoder. There the state of a prefix is the last piece of its
encoding, which is unique: a piece may follow another if no merge that comes before either of
them joins characters across their border. Both give what the sentencepiece library gives; but
where two orders of the same unigram pieces have equal sums, the library's choice follows from
the rounding of sums over the whole text before them, and may differ.

Texts are encoded in Arrow batches where they lie: nothing is shuffled. A batch is cut into
parts of `MOST_TEXTS` texts and `MOST_BYTES` bytes, or of one longer text. A task keeps the
pieces of the words that it has met of late, `MOST_WORDS` and those of two parts at most. They go
when it ends, so that a worker doesn't hold them while it waits or does other work.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.text import aside
from oriel.sources import read_table

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MOST_WORDS, MOST_PAIRS = 250_000, 200_000
#: Texts and their bytes that are encoded together.
MOST_TEXTS, MOST_BYTES = 1000, 1 << 21
#: Kinds of pieces in a model file.
NORMAL, CONTROL, USER, BYTE = 1, 3, 4, 6


@dataclass
class Pieces:
    """A model: what its pieces are, and what a forward pass needs of them."""

    names: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    dummy_prefix: bool
    unknown: int
    byte_ids: list[int] = field(init=False)
    ids: dict[str, int] = field(init=False)
    #: Every prefix of a piece: the piece's id, or -1 if it is only a prefix.
    prefixes: dict[str, int] = field(init=False)
    #: Merge models: when a piece is merged (0: a character), and from what.
    order: list[int] = field(init=False)
    parts: list[tuple[int, int] | None] = field(init=False)

    def __post_init__(self) -> None:
        self.ids = {x: k for k, (x, kind) in enumerate(zip(self.names, self.kinds, strict=True)) if kind == NORMAL}
        self.byte_ids = [k for k, kind in enumerate(self.kinds) if kind == BYTE]
        self.order, self.parts = [0] * len(self.names), [None] * len(self.names)
        if not self.unigram:
            by_score = sorted((k for x, k in self.ids.items() if len(x) > 1), key=lambda k: -self.scores[k])
            for at, k in enumerate(by_score):
                self.order[k] = at + 1
            lost = [x for x in self.ids if len(x) > 1 and not self.find_parts(x)]
            for x in lost:  # the merges never make these
                del self.ids[x]
        self.prefixes = {}
        for x, k in self.ids.items():
            for n in range(1, len(x)):
                self.prefixes.setdefault(x[:n], -1)
            self.prefixes[x] = k

    def find_parts(self, piece: str) -> bool:
        """Merges the characters of one piece; True if they end as this piece."""
        run = list(piece)
        while len(run) > 1:
            joined = [(self.order[k], i) for i in range(len(run) - 1) if (k := self.ids.get(run[i] + run[i + 1])) is not None]
            if not joined:
                return False
            at = min(joined)[1]
            if len(run) == 2:
                ends = self.ids.get(run[0]), self.ids.get(run[1])
                if None in ends:
                    return False
                self.parts[self.ids[piece]] = ends
            run[at : at + 2] = [run[at] + run[at + 1]]
        return True


def load_pieces(path: str = MODEL) -> Pieces:
    """Reads a model file on the driver; its size is that of the vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as form

    model = form.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal, kinds = model.normalizer_spec, [p.type for p in model.pieces]
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or USER in kinds:
        raise ValueError("models that normalise texts or have user-defined pieces aren't supported")
    if any(MARK in p.piece.lstrip(MARK) for p in model.pieces):
        raise ValueError("a piece goes on after a space")
    return Pieces([p.piece for p in model.pieces], [p.score for p in model.pieces], kinds, model.trainer_spec.model_type == 1, normal.add_dummy_prefix, model.trainer_spec.unk_id)


class Encoder:
    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        inert = "".join(c for c in "\n\r\t" if not any(c in x for x in pieces.ids))
        rest = f"[^{MARK}{inert}]"
        self.words = re.compile(f"{MARK}*{rest}+|{MARK}+" + (f"|[{inert}]" if inert else "")).findall
        #: Pieces of words as 32-bit numbers: those met of late, and those before them.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.follows: dict[int, bool] = {}
        self.least = min(pieces.scores) - 10
        self.plain = [bytes([pieces.byte_ids.index(k)]) if kind == BYTE else b"" if kind == CONTROL else name.replace(MARK, " ").encode() for k, (name, kind) in enumerate(zip(pieces.names, pieces.kinds, strict=True))] if pieces.byte_ids else [name.replace(MARK, " ").encode() for name in pieces.names]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two stay apart: walks back through the merges at their border, the later first."""
        names, order, parts, ids = self.pieces.names, self.pieces.order, self.pieces.parts, self.pieces.ids
        limit = len(names) + 1  # merges from here on come too late to matter
        a, b = left, right
        while True:
            joined = ids.get(names[a] + names[b])
            if joined is not None and order[joined] < limit:
                return False
            # Of equal times none are alike but characters; the leftmost of equal merges goes first.
            if order[a] == 0 and order[b] == 0:
                return True
            if order[a] > order[b]:
                limit, a = order[a], parts[a][1]
            else:
                limit, b = order[b] + (order[a] != order[b] or a == b), parts[b][0]

    def encode_words(self, words: list[str]) -> None:
        """Adds words to the known ones; words are sorted and distinct."""
        walk = self._best_sums if self.pieces.unigram else self._last_pieces
        before, states = "", [(-1, 0, (), 0.0)]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            walk(word, states)
            ids, end = [], len(word)
            while end:  # from the end back; ids in reverse
                k, at = states[end][:2]
                if k >= 0:
                    ids.append(k)
                elif self.pieces.byte_ids:
                    ids += [self.pieces.byte_ids[x] for x in reversed(word[at:end].encode())]
                else:
                    ids.append(self.pieces.unknown)
                end = at
            ids.reverse()
            self.known[word] = array("i", ids).tobytes()
            before = word

    def _last_pieces(self, word: str, states: list) -> None:
        """Appends the state (last piece, its start, starts of pieces that may go on, 0) of each further prefix."""
        get, follows = self.pieces.prefixes.get, self.follows
        going = states[-1][2]
        for end in range(len(states), len(word) + 1):
            found, at, on = -1, end - 1, []
            for j in (*going, end - 1):
                k = get(word[j:end])
                if k is not None:
                    on.append(j)
                    if k >= 0 and found < 0:
                        left = states[j][0]
                        if left >= 0:
                            pair = left << 20 | k
                            ok = follows.get(pair)
                            if ok is None:
                                ok = follows[pair] = self.may_follow(left, k)
                            if ok:
                                found, at = k, j
                        else:
                            found, at = k, j
            states.append((found, at, on, 0.0))
            going = on

    def _best_sums(self, word: str, states: list) -> None:
        """The same with the best sum of scores as the last field; an unknown character costs `least`."""
        get, scores = self.pieces.prefixes.get, self.pieces.scores
        for end in range(len(states), len(word) + 1):
            found, at, on, best = -1, end - 1, [], states[end - 1][3] + self.least
            for j in (*states[end - 1][2], end - 1):
                k = get(word[j:end])
                if k is not None:
                    on.append(j)
                    if k >= 0 and (states[j][3] + scores[k] > best or found < 0 and j == end - 1):
                        found, at, best = k, j, states[j][3] + scores[k]
            states.append((found, at, on, best))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the pieces of each text; an empty text has none."""
        prefix = MARK if self.pieces.dummy_prefix else ""
        cut = [self.words(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > MOST_WORDS // 2:
            self.known, self.older = {}, self.known
        if len(self.follows) > MOST_PAIRS:
            self.follows.clear()
        new = set().union(*cut) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self.encode_words(sorted(new - again))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, ws)), np.int32) for ws in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the pieces, without the space that encoding puts in front."""
        data = b"".join(map(self.plain.__getitem__, ids.tolist()))
        return (data[1:] if self.pieces.dummy_prefix and data[:1] == b" " else data).decode("utf-8", "replace")


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in order, by its last column's texts: MOST_TEXTS and MOST_BYTES at most, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        fits = np.searchsorted(ends, (ends[start - 1] if start else 0) + MOST_BYTES, "right")
        size = min(MOST_TEXTS, max(1, int(fits) - start))
        yield batch.slice(start, size)
        start += size


def _encoder(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(sent.value)
        for batch in batches:
            for part in parts_of(batch):
                texts = [x or "" for x in part.column(part.num_columns - 1).to_pylist()]
                ids = coder.encode(texts)
                same = [coder.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([*ids, np.empty(0, np.int32)])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(same)], [*part.schema.names[:-1], "token_ids", "n_tokens", "round_trip"])

    return encode


def encode_texts(docs: DataFrame, keep: list[str], text_col: str = "text", model: str = MODEL) -> DataFrame:
    """The columns keep of docs, and token_ids (array of int), n_tokens (long), round_trip (boolean).

    round_trip: decoding the ids gives the text again; only texts with U+2581 of their own lose
    it, as that character stands for a space. A null text is encoded as an empty one: no ids.
    A kept column of one of these names is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load_pieces(model))
    made = ["token_ids", "n_tokens", "round_trip"]
    kept, back = aside(docs, keep, made)
    chosen = docs.select(*kept, docs[text_col].alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "token_ids array<int>, n_tokens long, round_trip boolean"])
    return chosen.mapInArrow(_encoder(sent), schema).select(*back, *made)


def decode_ids(ids: Column, spark: SparkSession, model: str = MODEL) -> Column:
    """The texts of arrays of ids; null for null."""
    sent = spark.sparkContext.broadcast(load_pieces(model))

    @F.pandas_udf("string")
    def decoded(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Encoder(sent.value)
        for row in rows:
            yield row.map(lambda x: None if x is None else coder.decode(np.asarray(x)))

    return decoded(ids)


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encode_texts() of all documents; null and empty texts have no ids, repeated rows count each time."""
    return encode_texts(read_table(spark, sf_dir, "documents"), ["doc_id"])
