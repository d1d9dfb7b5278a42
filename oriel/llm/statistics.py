"""Statistics of whole texts, taken over their UTF-8 bytes in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "long_words", "symbols", "pipes", "exclaims", "stops", "capitals", "digits", "marks", "dup_lines", "repeat_words", "distinct_words", "words_a_line", "log_words", "bare_words")


def repeated_words(ids: np.ndarray, distinct: int, width: int = 5) -> int:
    """Positions under a window of `width` words that occurs twice or more; ids: word numbers from 0 to distinct - 1."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    if distinct**width < 1 << 62:
        keys = ids[:n].copy()
        for k in range(1, width):
            keys = keys * distinct + ids[k : n + k]
    else:  # number the windows of each width in turn, so that the keys stay small
        keys = ids
        for k in range(1, width):
            keys = np.unique(keys[: len(ids) - k] * distinct + ids[k:], return_inverse=True)[1]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(keys, twice))
    steps = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + width, minlength=len(ids) + 1)[: len(ids) + 1]
    return int((np.cumsum(steps)[: len(ids)] > 0).sum())


def describe(data: bytes) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of one text; without words all are 0."""
    words = data.split()
    if not words:
        return [0] * len(COUNTS), [0.0] * len(RATIOS)
    n, each = len(words), np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = int(len(data) - each[0x80:0xC0].sum() - each[list(SPACES)].sum())
    symbols = int(each[list(SYMBOLS)].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    doubled = len(lines) - len(set(lines))
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    repeated = repeated_words(ids, len(index))
    letters = max(1, int(each[65:91].sum() + each[97:123].sum()))
    sizes = np.fromiter(map(len, words), np.int64, n)
    bare = sum(map(bytes.isalpha, words)) / n
    ratios = [chars / n, float((sizes > 14).mean()), symbols / chars, each[124] / chars, each[33] / chars, each[46] / n, each[65:91].sum() / letters, each[48:58].sum() / chars, (each[33:48].sum() + each[58:65].sum()) / chars,
              doubled / len(lines), repeated / n, len(index) / n, n / len(lines), float(np.log1p(n)), bare]
    return [n, chars, symbols, doubled, repeated], [float(x) for x in ratios]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [describe(x.as_py() or b"") for x in batch.column(1).cast(pa.binary())]
        counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(COUNTS))
        ratios = np.array([r for _, r in found], np.float64).reshape(-1, len(RATIOS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in counts.T], *[pa.array(r) for r in ratios.T]], ["doc_id", *COUNTS, *RATIOS])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, COUNTS as long, RATIOS as double), one for each row; a null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *[f"{c} long" for c in COUNTS], *[f"{r} double" for r in RATIOS]])
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_describe, schema)
