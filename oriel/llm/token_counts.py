"""Token counts by a tokenizer that is compiled into finite-state transducers.

Two transducers, one behind the other, count what the tokenizer's file describes:

- The splitter reads classes of characters and says where words start. It has seven states, and
  its table is written out below. A text is cut into chunks of equal length; for each chunk the
  map from every state before it to the state after it is built for all chunks at once, and these
  maps are composed in a prefix scan of doubling steps. With the state before each chunk known,
  all chunks emit their word starts side by side. White space leads to the same state from
  everywhere, so the texts of a batch are scanned as one.
- The merger reads the bytes of a word, the last one marked, and every transition says by how
  many tokens the count changes. A state holds all that the next bytes can depend on: for each
  earlier place from which a token may still grow, the letters since, the last token before it, and
  how many tokens the text up to it has less than the text up to here. The last token of a prefix
  is unique: one whose merge isn't undone by what stands before it. States and transitions are
  made when they are first met, `MOST_STATES` at most at a time.

Word classes are those of the tokenizer's own splitter, asked once for every character. Counts
are made in Arrow batches where the texts lie: nothing is shuffled, and no ids are made.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.text import aside
from oriel.sources import read_table

FILE, LIMIT = "word_bpe_49k.json", 2048
CHUNK, MOST_STATES, MOST_WORDS = 1024, 60_000, 400_000
#: Characters that are scanned together, if a single text isn't longer.
SCANNED = 4_000_000

#: Classes of characters: white space, a letter, a digit, a sign, an apostrophe, one of s t m d, and r, v, l, e.
SPACE, LETTER, DIGIT, SIGN, QUOTE, ENDS, R, V, L, E = range(10)
#: States of the splitter: a word is over; in letters; in signs; an apostrophe that opened a word; and that one with r, v or l behind it.
OVER, IN_LETTERS, IN_SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(7)
#: What a step emits: a word starts here, or it started one character before, or both.
HERE, BEFORE = 1, 2


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Tables (state, class) of the next state and of what is emitted, for the pattern 's|'t|'re|'ve|'m|'ll|'d|letters|digit|signs."""
    fresh = {SPACE: (OVER, 0), DIGIT: (OVER, HERE), SIGN: (IN_SIGNS, HERE), QUOTE: (QUOTED, HERE)} | dict.fromkeys((LETTER, ENDS, R, V, L, E), (IN_LETTERS, HERE))
    in_letters = fresh | dict.fromkeys((LETTER, ENDS, R, V, L, E), (IN_LETTERS, 0))
    signs = dict.fromkeys((SIGN, QUOTE), (IN_SIGNS, 0))
    quoted = fresh | signs | {ENDS: (OVER, 0), R: (QUOTED_R, 0), V: (QUOTED_V, 0), L: (QUOTED_L, 0)}
    # The letter after the apostrophe opens a word of its own, unless the two letters belong to the apostrophe.
    undone = {c: (state, emitted | BEFORE) for c, (state, emitted) in in_letters.items()}
    rows = [fresh, in_letters, fresh | signs, quoted, undone | {E: (OVER, 0)}, undone | {E: (OVER, 0)}, undone | {L: (OVER, 0)}]
    table = np.array([[row[c] for c in range(10)] for row in rows], np.uint8)
    return table[:, :, 0].copy(), table[:, :, 1].copy()


NEXT, EMITTED = splitter()


def word_starts(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Places at which words start. The last class must be SPACE, so that no word is open at the end."""
    n, states = len(classes), NEXT.shape[0]
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, SPACE, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    # Maps of the chunks: where every state leads.
    maps = np.tile(np.arange(states, dtype=np.uint8), (rows, 1))
    flat = NEXT.ravel()
    for step in steps:
        maps = flat[maps * 10 + step[:, None]]
    # Prefix scan: after the step of width w, row k holds the map of the 2w chunks that end with it.
    width = 1
    while width < rows:
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width], axis=1)
        width *= 2
    state = np.concatenate([[OVER], maps[:-1, OVER]]).astype(np.uint8)
    out = np.empty((chunk, rows), np.uint8)
    emitted = EMITTED.ravel()
    for k, step in enumerate(steps):
        at = state * 10 + step
        out[k], state = emitted[at], flat[at]
    out = out.T.ravel()[:n]
    marks = np.zeros(n, bool)
    marks[:] = out & HERE
    marks[:-1] |= (out[1:] & BEFORE) > 0
    return np.flatnonzero(marks)


@dataclass
class Merges:
    """The merges of a file: from which two tokens each is made, and when (0: a single symbol, never)."""

    texts: list[str]
    parts: list[tuple[int, int]]
    times: dict[int, int]
    order: list[int]
    #: Every prefix of a token that some text is cut into: the token, or -1 if it is only a prefix.
    prefixes: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        met: set[int] = set()
        for k in sorted(range(len(self.texts)), key=self.order.__getitem__):
            if not self.order[k] or (met.issuperset(self.parts[k]) and self.stay_apart(*self.parts[k], self.order[k])):
                met.add(k)
        self.prefixes = {}
        for k in sorted(met):
            x = self.texts[k]
            for n in range(1, len(x)):
                self.prefixes.setdefault(x[:n], -1)
            self.prefixes[x] = k

    def stay_apart(self, a: int, b: int, limit: int = 1 << 40) -> bool:
        """Whether no merge before `limit` joins symbols across the border of two tokens: walks back through what made them, the later first."""
        while True:
            if self.times.get(a << 20 | b, limit) < limit:
                return False
            if not self.order[a] and not self.order[b]:
                return True
            if self.order[a] > self.order[b]:
                limit, a = self.order[a], self.parts[a][1]
            else:  # of equal merges the leftmost goes first
                limit, b = self.order[b] + 1, self.parts[b][0]


@dataclass
class Compiled:
    """What is sent to the tasks: the merges, classes of characters, and the special strings of the file."""

    merges: Merges
    classes: np.ndarray
    specials: list[str]
    path: str
    made: Merger | None = field(default=None)

    def merger(self) -> Merger:
        """One for each worker, which keeps what it has met."""
        if self.made is None:
            self.made = Merger(self)
        return self.made


def byte_letters() -> dict[str, int]:
    """The letters by which such files write bytes: printable ones stand for themselves, others for 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def compile_tokenizer(path: str) -> Compiled:
    """Reads a file of merges with a mark for word ends; files with other rules raise ValueError."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    model, suffix = rules["model"], rules["model"]["end_of_word_suffix"]
    kinds = [x["type"] for x in rules["normalizer"]["normalizers"]], [x["type"] for x in rules["pre_tokenizer"]["pretokenizers"]]
    pattern = rules["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex")
    if model["type"] != "BPE" or not suffix or kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or pattern != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
        raise ValueError("only files of merges with word ends, lower case and this splitter are compiled")
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in rules["added_tokens"]):
        raise ValueError("special strings must stand as they are")
    letters = byte_letters()

    def symbols(token: str) -> str:
        """A token as one character a byte, the last of a word in a range of its own."""
        ended = token.endswith(suffix)
        out = [letters[c] for c in (token.removesuffix(suffix) if ended else token)]
        return "".join(map(chr, [*out[:-1], out[-1] + 256] if ended else out))

    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    special = {x["content"] for x in rules["added_tokens"]}
    tokens = [t for t in sorted(model["vocab"], key=model["vocab"].get) if t not in special]
    ids = {t: k for k, t in enumerate(tokens)}
    parts, order, times = [(-1, -1)] * len(tokens), [0] * len(tokens), {}
    for at, (x, y) in enumerate(pairs, 1):
        parts[ids[x + y]], order[ids[x + y]], times[ids[x] << 20 | ids[y]] = (ids[x], ids[y]), at, at
    return Compiled(Merges([symbols(t) for t in tokens], parts, times, order), character_classes(path), sorted(special, key=len, reverse=True), path)


def character_classes(path: str) -> np.ndarray:
    """The class of every character, as the file's splitter sees it: together with a letter (one word), with a sign, alone, or not at all."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer[0].pre_tokenize_str
    out = np.full(0x110000, DIGIT, np.uint8)
    runs = [(a, a + 256) for a in range(0, 0x110000, 256) if not 0xD800 <= a < 0xE000]
    while runs:  # what is alike throughout has one class, the rest is halved
        a, b = runs.pop()
        text = "".join(map(chr, range(a, b)))
        if not split(text):
            out[a:b] = SPACE
        elif split("a" + text)[0][1] == (0, b - a + 1):
            out[a:b] = LETTER
        elif split("#" + text)[0][1] == (0, b - a + 1):
            out[a:b] = SIGN
        elif b - a > 1:
            runs += [(a, (a + b) // 2), ((a + b) // 2, b)]
    for c, kind in {"'": QUOTE, "s": ENDS, "t": ENDS, "m": ENDS, "d": ENDS, "r": R, "v": V, "l": L, "e": E}.items():
        out[ord(c)] = kind
    return out


class Filled(dict):
    """A dictionary that makes a missing value from its key."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        found = self[key] = self.make(key)
        return found


class Merger:
    """The transducer of words, and the counts of words met of late."""

    def __init__(self, compiled: Compiled) -> None:
        from tokenizers import Tokenizer

        self.compiled = compiled
        self.normalise = Tokenizer.from_file(compiled.path).normalizer.normalize_str
        self.special = re.compile("|".join(map(re.escape, compiled.specials))) if compiled.specials else None
        # The trie of the tokens, by node and symbol, and of each node its token or -1.
        prefixes = compiled.merges.prefixes
        nodes = {"": 0} | {p: k for k, p in enumerate(prefixes, 1)}
        self.token = [-1, *prefixes.values()]
        self.child = {nodes[p[:-1]] << 9 | ord(p[-1]): k for p, k in nodes.items() if p}
        self.plain = Filled(lambda c: c.isspace() or self.normalise(c) == c.replace("Σ", "σ").lower())
        self.known = Filled(self.count_word)
        self.forget()

    def forget(self) -> None:
        #: Of a state: its places (node of the letters since, last token before, tokens less than here).
        self.states: list[tuple[tuple[int, int, int], ...]] = [((0, -1, 0),)]
        self.numbers: dict[tuple[tuple[int, int, int], ...], int] = {self.states[0]: 0}
        self.steps: dict[int, int] = {}
        self.fits: dict[int, bool] = {}

    def step(self, state: int, symbol: int) -> int:
        """Makes the transition: the next state's number (0 after the end of a word), then 8 bits for the change of the count."""
        child, tokens, fits, change, places = self.child.get, self.token, self.fits, None, []
        for node, last, less in self.states[state]:
            node = child(node << 9 | symbol)
            if node is None:
                continue
            token = tokens[node]
            if token >= 0 and change is None:
                fit = last < 0 or fits.get(last << 20 | token)
                if fit is None:
                    fit = fits[last << 20 | token] = self.compiled.merges.stay_apart(last, token)
                if fit:
                    end, change = token, 1 - less
            places.append((node, last, less))
        after = 0
        if symbol < 256:
            # Seen from here, every place has `change` more tokens to catch up with.
            key = (*((node, last, less + change) for node, last, less in places), (0, end, 0))
            after = self.numbers.get(key)
            if after is None:
                after = self.numbers[key] = len(self.states)
                self.states.append(key)
        made = self.steps[state << 9 | symbol] = after << 8 | change + 128
        return made

    def count_word(self, word: str) -> int:
        if len(self.states) > MOST_STATES or len(self.steps) > 10 * MOST_STATES or len(self.fits) > 10 * MOST_STATES:
            self.forget()
        data, get, state, total = word.encode(), self.steps.get, 0, 0
        for k, symbol in enumerate(data, 1 - len(data)):
            symbol = symbol if k else symbol + 256
            made = get(state << 9 | symbol)
            if made is None:
                made = self.step(state, symbol)
            state, total = made >> 8, total + (made & 255) - 128
        return total

    def normal(self, text: str) -> str:
        """The text as the file's rules for characters leave it, but for its white space, which splits words all the same.

        Where every character is left as lower case alone, so is a text whose characters are composed.
        """
        if text.isascii():
            return text.lower()
        if all(map(self.plain.__getitem__, set(text))) and unicodedata.is_normalized("NFC", text):
            return text.replace("Σ", "σ").lower()  # at the end of a word too, as characters are lowered one by one
        return self.normalise(text)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out, pieces, owners, size = np.zeros(len(texts), np.int64), [], [], 0
        for k, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            out[k] += len(parts) - 1
            for part in filter(None, parts):
                if size and size + len(part) > SCANNED:
                    self.scan(pieces, owners, out)
                    pieces, owners, size = [], [], 0
                pieces.append(self.normal(part))
                owners.append(k)
                size += len(part)
        self.scan(pieces, owners, out)
        return out

    def scan(self, pieces: list[str], owners: list[int], out: np.ndarray) -> None:
        """Adds to out the tokens of the pieces."""
        if not pieces:
            return
        flat = " ".join(pieces) + " "
        classes = self.compiled.classes[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = word_starts(classes)
        # A word goes on to the next start or white space.
        stops = np.flatnonzero(np.concatenate([[True], (classes[1:] == SPACE) & (classes[:-1] != SPACE)]))
        ends = np.minimum(np.append(starts[1:], len(flat)), stops[np.minimum(np.searchsorted(stops, starts, side="right"), len(stops) - 1)])
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        known = self.known
        counts = np.array([known[flat[a:b]] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        borders = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in pieces)]))
        sums = np.concatenate([[0], np.cumsum(counts)])
        np.add.at(out, owners, [int(sums[b] - sums[a]) for a, b in pairwise(borders)])


def _counter(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = sent.value.merger()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                counts = merger.count([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts)], [*part.schema.names[:-1], "n_tokens"])

    return count


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The columns keep of docs, and n_bytes (long, UTF-8), n_tokens (long), over_limit (more than limit).

    Special strings of the tokenizer within a text count as one token each, as its library takes
    them; nothing is added, cut or padded. A null text counts as an empty one. A kept
    column of one of these names is replaced; other columns of docs don't matter, whatever their names.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    sent = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(path))
    text = F.coalesce(docs[text_col], F.lit(""))
    kept, back = aside(docs, keep, ["n_bytes", "n_tokens", "over_limit"])
    chosen = docs.select(*kept, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "n_tokens long"])
    counted = chosen.mapInArrow(_counter(sent), schema)
    return counted.select(*back, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), ["doc_id"])
