"""Product codes of vectors, with annular norm pruning.

A vector is cut into parts; each part position has a codebook, and a part is
stored as the index of the nearest entry.  To find it, the entries of a
codebook are sorted by norm.  No entry whose norm differs from the part's by
more than the best distance so far can be nearer, so the interval of norms
that the best distance allows is found by binary search, and only that annulus
is evaluated, its edges included, exactly and in integers.

Codebooks are learned over all vectors: each task passes on the sums of what
it assigned, as many rows as the codebooks have numbers, and they are added up
on Spark.  What the driver holds is the codebooks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfline.llm.common import stored

#: Integers up to this size are handled in 64 bits; larger ones one by one, as
#: Python's, which is exact too.
NARROW = 1 << 20
#: Distances evaluated at once.
PAIRS = 1 << 20
#: Sums are shipped in limbs of so many bits, so no sum can leave 64.
LIMB = 40
MOST = (1 << 63) - 1
#: Parts that a label's total is joined in, so that no label is one task.
SALTS = 32


def is_finite(vec_col: str) -> Column:
    """Whether a vector is there and all its components are numbers."""
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.col(vec_col).isNotNull() & fine


def _scaled(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64 where all are narrow, else Python's integers."""
    if not len(flat) or np.abs(flat).max() * scale < NARROW:
        return np.floor(flat * scale).astype(np.int64)
    # From 2 ** 53 on a double is a whole number.
    return np.array([int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in flat.tolist()], dtype=object)


def _matrix(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """The vectors of a batch as rows of ``width`` integers, shorter ones
    filled up with zeros."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = _scaled(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
    if (lens == width).all():
        return values.reshape(len(lens), width)
    out = np.zeros((len(lens), width), dtype=values.dtype)
    row = np.repeat(np.arange(len(lens)), lens)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lens) - lens, lens)] = values
    return out


class Book:
    """A codebook, its entries sorted by norm."""

    def __init__(self, entries: np.ndarray):
        # Python's integers (dtype object) or int64.
        self.narrow = not entries.size or max(abs(int(x)) for x in entries.ravel()) < NARROW
        entries = entries.astype(np.int64 if self.narrow else object)
        self.squares = (entries * entries).sum(axis=1)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: int(self.squares[i])), dtype=np.int64)
        self.sorted = entries[self.order]
        self.norms = np.sqrt(self.squares[self.order].astype(np.float64)) if self.narrow else None

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part (ties: the lower) and the
        squared distance."""
        if self.narrow and parts.dtype != object and parts.shape[1] < 1 << 12:
            step = max(1, PAIRS // (len(self.order) * parts.shape[1]))
            found = [self._annulus(parts[i : i + step]) for i in range(0, len(parts), step)]
            return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        found = [self._one([int(x) for x in part]) for part in parts]
        return np.array([f[0] for f in found], dtype=np.int64), np.array([f[1] for f in found], dtype=object)

    def _annulus(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.order)
        norms = np.sqrt((parts * parts).sum(axis=1).astype(np.float64))
        # The entries of the norms next to the part's give the first distance.
        at = np.searchsorted(self.norms, norms)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        for k in (-1, 0):
            gap = parts - self.sorted[np.clip(at + k, 0, n - 1)]
            best = np.minimum(best, (gap * gap).sum(axis=1))
        # Norms below 2 ** 26: the slack is far above what rounding can move.
        reach = np.sqrt(best.astype(np.float64)) + 1e-3
        low, high = np.searchsorted(self.norms, norms - reach), np.searchsorted(self.norms, norms + reach, "right")
        wide = high - low
        row = np.repeat(np.arange(len(parts)), wide)
        starts = np.cumsum(wide) - wide
        entry = np.arange(int(wide.sum())) - np.repeat(starts - low, wide)
        gap = parts[row] - self.sorted[entry]
        keys = (gap * gap).sum(axis=1) * 256 + self.order[entry]  # distances below 2 ** 54
        least = np.minimum.reduceat(keys, starts)
        return least & 255, least >> 8

    def _one(self, part: list[int]) -> tuple[int, int]:
        """The same for one part in integers of any size."""
        square = sum(x * x for x in part)
        norm, norms = math.isqrt(square), [math.isqrt(int(self.squares[i])) for i in self.order]
        distance = lambda k: sum((x - int(y)) ** 2 for x, y in zip(part, self.sorted[k], strict=True))
        first = min(range(len(norms)), key=lambda k: abs(norms[k] - norm))
        best, index = distance(first), int(self.order[first])
        reach = math.isqrt(best) + 2  # the norms are rounded down
        low = int(np.searchsorted(np.array(norms, dtype=object), norm - reach))
        for k in range(low, len(norms)):
            if norms[k] > norm + reach:
                break
            best, index = min((best, index), (distance(k), int(self.order[k])))
        return index, best


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position within the part (integers)."""

    entries: list[list[list[int]]]
    scale: int = 256

    @property
    def width(self) -> int:
        return len(self.entries) * len(self.entries[0][0])

    def sha256(self) -> str:
        text = ",".join(str(x) for book in self.entries for entry in book for x in entry)
        return hashlib.sha256(text.encode()).hexdigest()

    def books(self) -> list[Book]:
        return [Book(np.array(book, dtype=object)) for book in self.entries]

    def assign(self, column: pa.Array, books: list[Book]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part position: the parts, their codes and distances."""
        matrix = _matrix(column, self.scale, self.width)
        m = self.width // len(books)
        for p, book in enumerate(books):
            parts = matrix[:, p * m : (p + 1) * m]
            yield parts, *book.nearest(parts)


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    """Limbs of an integer, all of its sign."""
    sign, x, k = (-1 if x < 0 else 1), abs(x), 0
    while x:
        if low := x & ((1 << LIMB) - 1):
            yield k, sign * low
        x, k = x >> LIMB, k + 1


def _moved(vectors: DataFrame, vec_col: str, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts."""
    parts, m = len(books.entries), len(books.entries[0][0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = books.books()
        # Of each part, entry and position the sum; at the last place the count.
        total = np.zeros((parts, len(books.entries[0]), m + 1), dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, (rows, codes, _) in enumerate(books.assign(batch.column(0), held)):
                if rows.dtype == object:
                    for row, code in zip(rows, codes, strict=True):
                        total[p, code, :m] += row
                else:
                    # A batch's sums of narrow integers are exact in doubles.
                    for k in range(m):
                        total[p, :, k] += np.bincount(codes, rows[:, k], len(total[p])).astype(np.int64).astype(object)
                total[p, :, m] += np.bincount(codes, minlength=len(total[p])).astype(object)
        out = [(p, e, k, limb, v) for p, book in enumerate(total) for e, row in enumerate(book) if row[m] for k, x in enumerate(row) for limb, v in _limbs(int(x))]
        names = ["part", "entry", "place", "limb", "n"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64() if i == 4 else pa.int32()) for i in range(5)], names=names)

    shipped = vectors.select(vec_col).mapInArrow(sums, "part int, entry int, place int, limb int, n bigint")
    found: dict[tuple[int, int, int], int] = {}
    for r in shipped.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():  # the codebooks' numbers
        found[r.part, r.entry, r.place] = found.get((r.part, r.entry, r.place), 0) + (int(r.n) << (LIMB * r.limb))
    entries = [
        [[found.get((p, e, k), 0) // found[p, e, m] for k in range(m)] if (p, e, m) in found else entry for e, entry in enumerate(book)]
        for p, book in enumerate(books.entries)
    ]
    return Codebooks(entries, books.scale)


def learn(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of the vectors of ``df``: they start as the parts of the
    ``entries`` (at most 256) smallest ids' vectors and move ``rounds`` times.
    Unused entries stay.  None where there is no vector.

    Rows whose vector is null or holds null or a number that is not finite
    play no part.  Vectors are filled up with zeros to the longest, and that to
    a multiple of ``parts``.  Rows of one id start in the order of their
    vectors, null ids last.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries fit two hex digits")
    vectors = df.where(is_finite(vec_col))
    # As many rows as a codebook has entries.
    first = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    longest = vectors.agg(F.max(F.size(vec_col))).first()[0]
    m = max(1, -(-longest // parts))
    start = _matrix(pa.array([[float(x) for x in r.v] for r in first], pa.list_(pa.float64())), scale, m * parts)
    books = Codebooks([[[int(x) for x in row[p * m : (p + 1) * m]] for row in start] for p in range(parts)], scale)
    for _ in range(rounds):
        books = _moved(vectors, vec_col, books)
    return books


def encode(df: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distance,
    summed over the parts; 2 ** 63 - 1 where it is larger) of every vector;
    rows without a finite vector go, and those of vectors longer than the
    codebooks; repeated rows and null ids stay."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = books.books()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [(c, d) for _, c, d in books.assign(batch.column(2), held)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            hexed = code.tobytes().hex()
            wide = 2 * len(found)
            error = sum(d.astype(object) for _, d in found) if any(d.dtype == object for _, d in found) else np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([hexed[i : i + wide] for i in range(0, len(hexed), wide)]), pa.array([min(int(e), MOST) for e in error], pa.int64())],
                names=["id", "label", "code", "error"],
            )

    rows = df.where(is_finite(vec_col) & (F.size(vec_col) <= books.width)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    schema = StructType([*rows.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    return rows.mapInArrow(codes, schema)


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options: int) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls
    together) and codebooks_sha256 of every vector, by codebooks learned from
    all of them (see :func:`learn` and :func:`encode`).

    Ties go to the lower entry.  Repeated rows come out once each; an empty
    table, or one without a finite vector, gives no row.  Other columns, of
    whatever name, play no part.  Totals beyond 2 ** 63 - 1 are given as that.
    """
    books = learn(df, id_col, vec_col, **options)
    known = books or Codebooks([[[0]]])
    rows = encode(df if books else df.limit(0), known, id_col, vec_col, label_col)
    coded = stored(rows.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    totals = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = coded.join(totals, (F.col("salt") == F.col("part")) & F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(known.sha256()).alias("codebooks_sha256"))
