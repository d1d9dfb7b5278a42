"""Sums of arrays and exact quantiles by key, each from passes over the rows in Arrow batches.

A pass hands every batch of rows to a function that yields arrays by key; a key is a model, a
fold, a column, or any mix of them, so that a whole grid of models costs one pass. Tasks keep one
array a key. These are added in two steps, first among `SLOTS` groups of tasks, so that no task
adds more than a few arrays of a key; one array a key reaches the driver, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

#: What a pass does with a batch of rows as a matrix of doubles, gaps being nan.
Each = Callable[[np.ndarray], Iterable[tuple[int, np.ndarray]]]
SLOTS = 32
#: Distinct values of a stream that are told apart in one round of a selection.
TOLD_APART = 4096
TOP = np.uint64(1 << 63)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)


def _merged(parts: DataFrame, merge: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> pa.Table:
    """Rows of parts merged by key, first within slots; one row a key."""
    step = parts.repartition("key", "slot").mapInArrow(merge, parts.schema)
    return step.repartition("key").mapInArrow(merge, parts.schema).toArrow()


def _batch(rows: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _arrays(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.cumsum([0, *(flat.value_lengths().to_pylist())])
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in pairwise(ends)]


def _numbers(rows: DataFrame, columns: list[Column]) -> DataFrame:
    return rows.select(*[c.cast("double").alias(f"x{k}") for k, c in enumerate(columns)])


def sum_arrays(rows: DataFrame, columns: list[Column], each: Each) -> dict[int, np.ndarray]:
    """The sums of the arrays that `each` yields, by key; a key's arrays have one shape."""
    form, names = "key long, slot int, shape array<int>, part array<double>", ["key", "slot", "shape", "part"]
    types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.float64())]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for x in _matrices(batches):
            for key, part in each(x):
                sums[key] = sums.get(key, 0.0) + part
        slot = TaskContext.get().partitionId() % SLOTS
        yield _batch([[key, slot, s.shape, s.ravel()] for key, s in sums.items()], types, names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        for batch in batches:
            for key, slot, shape, part in zip(batch["key"].to_pylist(), batch["slot"].to_pylist(), _arrays(batch["shape"]), _arrays(batch["part"]), strict=True):
                if key in rows:
                    rows[key][3] = rows[key][3] + part
                else:
                    rows[key] = [key, slot, shape, part]
        yield _batch(list(rows.values()), types, names)

    found = _merged(_numbers(rows, columns).mapInArrow(partial, form), add)
    return {k: part.reshape(shape) for k, shape, part in zip(found["key"].to_pylist(), _arrays(found["shape"]), _arrays(found["part"]), strict=True)}


def _codes(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits & TOP, ~bits, bits | TOP)


def _doubles(codes: np.ndarray) -> np.ndarray:
    return np.where(codes & TOP, codes ^ TOP, ~codes).view(np.float64)


def _double(code: int) -> float:
    return float(_doubles(np.array([code], np.uint64))[0])


def _coarse(codes: np.ndarray, counts: np.ndarray, level: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Counts by code with equal codes added, of as many leading bits (by fours) as leave `most` of them."""
    while True:
        mask = np.uint64(0xFFFFFFFFFFFFFFFF << (64 - level) & 0xFFFFFFFFFFFFFFFF)
        found, place = np.unique(codes & mask, return_inverse=True)
        if len(found) <= most or level <= 4:
            return found, np.bincount(place, counts, len(found)).astype(np.int64), level
        level -= 4


def _histograms(rows: DataFrame, columns: list[Column], each: Each, spans: dict[int, list[tuple[int, int]]] | None, most: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Codes, counts and level of each stream, or of each span of it that is asked for, under key * 64 + its number."""
    most = max(most, 16)  # four more bits of a span always fit
    form, names = "key long, slot int, level int, codes array<long>, counts array<long>", ["key", "slot", "level", "codes", "counts"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def record(key: int, slot: int, codes: np.ndarray, counts: np.ndarray, level: int) -> list:
        return [key, slot, level, codes.view(np.int64), counts]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

        def put(key: int, codes: np.ndarray) -> None:
            old, counts, level = kept.get(key, (np.zeros(0, np.uint64), np.zeros(0, np.int64), 64))
            kept[key] = _coarse(np.concatenate([old, codes]), np.concatenate([counts, np.ones(len(codes), np.int64)]), level, most)

        for x in _matrices(batches):
            for key, values in each(x):
                if spans is not None and key not in spans:
                    continue
                codes = _codes(values[~np.isnan(values)])
                if spans is None:
                    put(key * 64, codes)
                else:
                    for k, (low, high) in enumerate(spans[key]):
                        put(key * 64 + k, codes[(codes >= np.uint64(low)) & (codes <= np.uint64(high))])
        slot = TaskContext.get().partitionId() % SLOTS
        yield _batch([record(key, slot, *h) for key, h in kept.items()], types, names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for key, slot, level, codes, counts in zip(*[batch[c].to_pylist() for c in names[:3]], _arrays(batch["codes"]), _arrays(batch["counts"]), strict=True):
                if key in held:
                    old = held[key]
                    both = np.concatenate([old[3].view(np.uint64), codes.view(np.uint64)]), np.concatenate([old[4], counts])
                    held[key] = record(key, slot, *_coarse(*both, min(old[2], level), most))
                else:
                    held[key] = [key, slot, level, codes, counts]
        yield _batch(list(held.values()), types, names)

    found = _merged(_numbers(rows, columns).mapInArrow(partial, form), merge)
    lists = zip(_arrays(found["codes"]), _arrays(found["counts"]), found["level"].to_pylist(), strict=True)
    return {k: (codes.view(np.uint64), counts, level) for k, (codes, counts, level) in zip(found["key"].to_pylist(), lists, strict=True)}


class Selected:
    """The wanted order statistics of one stream, narrowed round by round; and all its values, if one round told them apart."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, level: int, at: tuple[float, ...]) -> None:
        self.count, self.at = int(counts.sum()), at
        self.all = (codes, counts) if level == 64 else None
        ranks = {r for q in at for r in (int(np.floor(q * (self.count - 1))), int(np.ceil(q * (self.count - 1))))} if self.count else set()
        #: Rank: its code if it is known, else (first code, last code, values below the first).
        self.known: dict[int, int] = {}
        self.spans: dict[int, tuple[int, int, int]] = {}
        for r in ranks:
            self.place(r, codes, counts, level, 0)

    def place(self, rank: int, codes: np.ndarray, counts: np.ndarray, level: int, below: int) -> None:
        before = below + np.concatenate([[0], np.cumsum(counts)])
        k = int(np.searchsorted(before, rank, side="right")) - 1
        if level == 64:
            self.known[rank] = int(codes[k])
            self.spans.pop(rank, None)
        else:
            self.spans[rank] = (int(codes[k]), int(codes[k]) + (1 << (64 - level)) - 1, int(before[k]))

    def quantiles(self) -> list[float]:
        """By linear interpolation between the two values around each; nan without values."""
        out = []
        for q in self.at:
            place = q * (self.count - 1)
            if not self.count:
                out.append(float("nan"))
                continue
            low, high = (_double(self.known[int(r(place))]) for r in (np.floor, np.ceil))
            out.append(float(low + (high - low) * (place - np.floor(place))))
        return out


def select(rows: DataFrame, columns: list[Column], each: Each, at: tuple[float, ...], most: int = TOLD_APART) -> dict[int, Selected]:
    """Exact order statistics of the streams of values that `each` yields by key (under 2^56); nan doesn't count.

    A round counts values by the leading bits of their codes, of which tasks keep as many as tell
    `most` apart, and goes on within the few bins that hold what is asked for. A stream of at
    most `most` distinct values takes one round; no task or driver ever holds more of any.
    """
    out = {k // 64: Selected(*h, at) for k, h in _histograms(rows, columns, each, None, most).items()}
    while spans := {k: sorted({x[:2] for x in s.spans.values()}) for k, s in out.items() if s.spans}:
        found = _histograms(rows, columns, each, spans, most)
        for k, own in spans.items():
            for rank, (low, high, below) in list(out[k].spans.items()):
                out[k].place(rank, *found[k * 64 + own.index((low, high))], below)
    return out


def quantiles(rows: DataFrame, columns: list[Column], each: Each, at: tuple[float, ...], most: int = TOLD_APART) -> dict[int, list[float]]:
    return {k: s.quantiles() for k, s in select(rows, columns, each, at, most).items()}


def medians_and_spreads(rows: DataFrame, columns: list[Column], each: Each, most: int = TOLD_APART) -> dict[int, tuple[float, float]]:
    """Of each stream its median, and the median distance from it: from the same round where that told all values apart, else by another selection."""
    found = select(rows, columns, each, (0.5,), most)
    middles = {k: s.quantiles()[0] for k, s in found.items()}
    out = {}
    for k, s in found.items():
        if s.all is not None and s.count:
            far = _codes(np.abs(_doubles(s.all[0]) - middles[k]))
            out[k] = middles[k], Selected(*_coarse(far, s.all[1], 64, len(far)), (0.5,)).quantiles()[0]
    left = found.keys() - out.keys()
    if left:
        away = quantiles(rows, columns, lambda x: ((k, np.abs(v - middles[k])) for k, v in each(x) if k in left), (0.5,), most)
        out |= {k: (middles[k], a[0]) for k, a in away.items()}
    return out
