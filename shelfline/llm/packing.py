"""Best-fit packing of documents into training sequences.

Documents become token ids; only what is longer than a sequence is cut.  The
packing problem depends on lengths alone, and there are no more different
lengths than a sequence has places, so it is solved on the histogram of
lengths: first the Martello-Toth reduction fixes sets of up to three pieces
that provably dominate every other set with their largest piece, again and
again; the remainder goes best-fit, longest first.  The solution is a short
list of patterns, dealt to the pieces by their rank within their length.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfline.llm.common import span_hashes, stored, text_slices
from shelfline.llm.pretokens import code_points, word_level_spans
from shelfline.llm.token_counts import byte_letters

SEQUENCE = 2048
#: Pieces of words whose ids a worker keeps; then it begins anew.
KEPT_WORDS = 400_000
#: Pieces that one task ranks, about.
RANKED_ROWS = 100_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Ids as the library gives them: a word's pieces are merged once by the
    library's model, and found again by their hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.model = Tokenizer.from_file(path).model
        self.letter = {b: c for c, b in byte_letters().items()}
        self.known: dict[int, bytes] = {}

    def _word(self, word: str) -> bytes:
        text = word.encode().decode("latin-1").translate(self.letter)
        return np.array([t.id for t in self.model.tokenize(text)], dtype=np.uint32).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by id 0, and the texts' offsets."""
        parts, owner, tails = [], [], []
        for k, text in enumerate(texts):
            pieces = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
            for i in range(0, len(pieces), 2):
                # Per character: the library's lower-casing knows no final sigma.
                parts.append(unicodedata.normalize("NFC", pieces[i]).replace("Σ", "σ").lower())
                owner.append(k)
                tails.append(self.special[pieces[i + 1]] if i + 1 < len(pieces) else 0)
        joined, codes, offsets = code_points(parts)
        starts, lens, rows = word_level_spans(codes, offsets)
        keys, place, back = np.unique(span_hashes(codes, starts, lens), return_index=True, return_inverse=True)
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known, found = self.known, []
        for key, at in zip(keys.tolist(), place.tolist(), strict=True):
            ids = known.get(key)
            if ids is None:
                ids = known[key] = self._word(joined[starts[at] : starts[at] + lens[at]])
            found.append(ids)
        pool = np.concatenate([np.frombuffer(b"".join(found), dtype=np.uint32), np.array(tails, dtype=np.uint32)])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        # A part's pieces, then its tail.
        order = np.argsort(np.concatenate([rows, np.arange(len(parts))]), kind="stable")
        size = np.concatenate([sizes[back], np.ones(len(parts), dtype=np.int64)])[order]
        begin = np.concatenate([begins[back], len(pool) - len(parts) + np.arange(len(parts))])[order]
        out = np.cumsum(size) - size
        ids = pool[np.repeat(begin - out, size) + np.arange(int(size.sum()))]
        per_part = np.bincount(rows, weights=sizes[back], minlength=len(parts)).astype(np.int64) + 1
        per_text = np.bincount(np.array(owner, dtype=np.int64), weights=per_part, minlength=len(texts)).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            column, names = batch["text"], batch["doc_id"]
            for first, last, data, offsets in text_slices(column):
                whole = data.tobytes()
                ids, ends = coder.encode([whole[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                n = -(-np.diff(ends) // size)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, np.diff(ends)[row] - start)
                at = (ends[:-1][row] + start).tolist()
                crc = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(at, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, last - first).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(rows, PIECES)


#: A pattern: runs of (length, how many) and the number of sequences filled so.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def _fitting(counts: np.ndarray, room: int, without: dict[int, int]) -> int:
    """The longest piece of at most ``room``, beside those taken; 0 if none."""
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        if counts[length] > without.get(length, 0):
            return length
    return 0


def _shortest(counts: np.ndarray, n: int, without: int) -> list[int]:
    """The ``n`` shortest pieces, beside one of length ``without``."""
    found: list[int] = []
    for length in np.flatnonzero(counts).tolist():
        found += [length] * min(n, int(counts[length]) - (length == without))
        if len(found) >= n:
            break
    return found[:n]


def _dominating(counts: np.ndarray, length: int, size: int) -> tuple[int, ...] | None:
    """A set with this piece that dominates all others with it, if proved."""
    room = size - length
    one = _fitting(counts, room, {length: 1})
    if not one:
        return (length,)
    if one == room:
        return (length, one)
    short = _shortest(counts, 3, length)
    if len(short) < 2 or length + short[0] + short[1] > size:
        return (length, one)
    if len(short) == 3 and length + sum(short) <= size:
        return None
    # At most two others fit: the longest, and the longest beside it, dominate unless
    # some pair has a longer second piece and more in sum than the longest alone.
    taken = {length: 1}
    taken[one] = taken.get(one, 0) + 1
    two = _fitting(counts, room - one, taken)
    for t in np.flatnonzero(counts[:one]).tolist():
        u = _fitting(counts, min(t, room - t), {length: 1, t: 1 + (t == length)})
        if u > two and t + u > one:
            return None
    return (length, one, two) if two else (length, one)


def _times(counts: np.ndarray, chosen: tuple[int, ...]) -> int:
    return min(int(counts[length]) // chosen.count(length) for length in set(chosen))


def _runs(lengths) -> tuple[tuple[int, int], ...]:
    runs: list[list[int]] = []
    for length in lengths:
        if runs and runs[-1][0] == length:
            runs[-1][1] += 1
        else:
            runs.append([length, 1])
    return tuple((a, b) for a, b in runs)


def solve(counts: np.ndarray, size: int = SEQUENCE) -> list[Pattern]:
    """Patterns that use up ``counts[length]`` pieces of each length."""
    fixed, rest = reduce(counts, size)
    return fixed + _best_fit(rest, size)


def reduce(counts: np.ndarray, size: int) -> tuple[list[Pattern], np.ndarray]:
    """Patterns that are in some best solution, and the counts that remain."""
    counts = counts.astype(np.int64).copy()
    found: list[Pattern] = []
    again = True
    while again:
        again = False
        for length in np.flatnonzero(counts)[::-1].tolist():
            while counts[length]:
                chosen = _dominating(counts, length, size)
                if not chosen:
                    break
                times = _times(counts, chosen)
                for part in chosen:
                    counts[part] -= times
                found.append((_runs(chosen), times))
                again = True
    return found, counts


def _best_fit(counts: np.ndarray, size: int) -> list[Pattern]:
    """Best fit, longest first; sequences alike are kept as one group."""
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            room = min((r for r, held in groups.items() if r >= length and held), default=None)
            runs, n = groups[room].pop() if room is not None else ((), left)
            room = size if room is None else room
            each = room // length
            full = min(n, left // each)
            # Sequences that take all they can, one that takes the rest, those that take none.
            parts = [(each, full), (left - each * full, 1) if full < n and left % each else (0, 0)]
            used = 0
            for k, many in parts:
                if k and many:
                    groups.setdefault(room - k * length, []).append((runs + ((length, k),), many))
                    left -= k * many
                    used += many
            if runs and n > used:
                groups[room].append((runs, n - used))
    return [group for held in groups.values() for group in held]


def _segments(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, first sequence, run, offset): where the
    pieces of a length go by rank."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for runs, times in patterns:
        offset = 0
        for length, run in runs:
            rows.append((length, rank.get(length, 0), first, run, offset))
            rank[length] = rank.get(length, 0) + run * times
            offset += run * length
        first += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece (from 0), start, length, ids_crc32,
    sequence_id and offset.

    ``tokenizer`` is the path of a word-end BPE's JSON file, there on every
    executor.  A null or empty text is the closing id alone.  Repeated rows
    are packed each, a null id stays null, other columns play no part, and an
    empty table has no piece.  To the driver come the counts of at most
    ``size`` lengths.
    """
    # The number of a piece's row, once written, deals out those of one id too.
    cut = stored(pieces(docs, tokenizer, size, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
    segments = cut.sparkSession.sparkContext.broadcast(_segments(solve(counts, size)))
    salts = max(16, int(counts.max()) // RANKED_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("row")
    ranked = salted.withColumn("rank", F.row_number().over(inside)).join(starts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("before")).alias("rank"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = segments.value
        keys = table[:, 0] << 45 | table[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, length << 45 | rank, "right") - 1
            inner = rank - table[at, 1]
            sequence, offset = table[at, 2] + inner // table[at, 3], table[at, 4] + inner % table[at, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(placed, PIECES + ", sequence_id bigint, offset bigint")
