"""Shared pieces of the training-data operators: folders that all executors
see, and vectorised word spans and hashes over Arrow string columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.plans.storage import shared_dir, stored

__all__ = ["code_values", "free_names", "lowered", "mix64", "most_frequent", "powers", "shared_dir", "span_hashes", "stored", "text_slices", "word_spans", "words_of"]

def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes to be none of the
    table's own columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of text handled at once by the vectorised helpers (one longer text is
#: still handled whole); bounds the memory of a task, not what it reads.
SLICE_BYTES = 500_000


def most_frequent(table: DataFrame, count: str, most: int) -> tuple[DataFrame, int]:
    """The rows of the largest counts (>= 1), ``most`` at most, and the least
    count among them, found by a histogram of the counts: no sort, and rows of
    one count class (a quarter of a doubling) stay or go together."""
    steps = table.groupBy(F.floor(F.log2(count) * 4).cast("int").alias("step")).count().collect()
    least, fits = 1, 0
    for row in sorted(steps, key=lambda r: -r.step):
        fits += row["count"]
        if fits > most:
            least = math.ceil(2 ** ((row.step + 1) / 4) - 1e-9)
            break
    return table.where(F.col(count) >= least), least


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_CODE = mix64(np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77))
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """At least the first ``n`` powers of the multiplier of span_hashes."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 64), 0xD6E8FEB86659FD93, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps)
    return _POWERS


def code_values(codes: np.ndarray) -> np.ndarray:
    """What each byte or code point adds to a hash."""
    if codes.dtype == np.uint8:
        return _CODE[codes]
    codes = codes.astype(np.int64)
    return _CODE[codes & 0xFFFF] + _CODE[codes >> 16] * np.uint64(3)


def span_hashes(codes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span ``codes[start:start + len]`` (len > 0).

    ``codes`` are bytes or code points.  Equal spans hash alike everywhere;
    the chance that any two of n different spans collide is about n^2 / 2^65.
    """
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(offsets, lens)
    x = code_values(codes[place + np.repeat(starts, lens)])
    return mix64(np.add.reduceat(x * powers(int(lens.max()))[place], offsets) + lens.astype(np.uint64))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges ``(first, last, bytes, offsets)`` of a string column; null
    counts as empty.  Each range has at most ``most`` bytes, or one row."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of each word ``[^\\x20\\x09-\\x0D]+``."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    word = ~_WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = word[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = word[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: first and last row, lower-cased bytes, and of each word its
    start, length, row within the slice and hash."""
    for first, last, data, offsets in text_slices(column):
        data = lowered(data)
        starts, lens, rows = word_spans(data, offsets)
        yield first, last, data, starts, lens, rows, span_hashes(data, starts, lens)
