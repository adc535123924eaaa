"""Pretoken spans of many texts at once: code points, their classes, and the
places where a tokenizer's split pattern starts a piece.

Both patterns are local: whether a piece starts at a place depends on a few
characters around it, so the automaton that finds the pieces is evaluated at
all places at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE, WHITE = 1, 2, 3, 4, 5
#: Contraction endings after an apostrophe.
ONE, TWO = "stmd", ("re", "ve", "ll")


@cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(every)
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", WHITE)):
        table[[ord(c) for c in regex.findall(pattern, text)]] = kind
    table[0x20] = SPACE
    return table


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, their code points, and the offsets of the texts."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    return joined, codes, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def _contractions(codes: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes ``at`` those that begin a contraction, and its
    length.  ``ends``: per place of ``at``, where its text ends."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(3, dtype=codes.dtype)])
    one = np.where(at + 1 < np.minimum(ends, n), padded[at + 1], 0)
    two = np.where(at + 2 < np.minimum(ends, n), padded[at + 2], 0)
    size = np.where(np.isin(one, [ord(c) for c in ONE]), 2, 0)
    for pair in TWO:
        size = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 3, size)
    return at[size > 0], size[size > 0]


def _neighbours(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = class_table()[codes]
    before, after = np.zeros_like(kind), np.zeros_like(kind)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    n = len(codes)
    before[offsets[:-1][offsets[:-1] < n]] = 0
    after[offsets[1:][offsets[1:] > 0] - 1] = 0
    return kind, before, after


def _split_contractions(codes: np.ndarray, offsets: np.ndarray, kind: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
    if not len(at):
        return
    at, size = _contractions(codes, offsets[np.searchsorted(offsets, at, "right")], at)
    start[at + 1] = False
    end = at + size
    same = (end < len(codes)) & ~np.isin(end, offsets)
    end = end[same]
    start[end[kind[end] == LETTER]] = True


def byte_level_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each piece of the byte-level pattern: a
    contraction; letters, numbers or others, each with one space before; white
    space without its last character where something follows; white space."""
    if not len(codes):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    kind, before, after = _neighbours(codes, offsets)
    white, white_before = kind >= SPACE, before >= SPACE
    start = np.where(white, ~white_before | ((after > 0) & (after < SPACE)), (before != kind) & (before != SPACE))
    apostrophe = np.flatnonzero((codes == 0x27) & start)
    _split_contractions(codes, offsets, kind, start, apostrophe)
    starts = np.flatnonzero(start)
    rows = np.searchsorted(offsets, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(codes)), offsets[rows + 1])
    return starts, ends - starts, rows


def word_level_spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of each piece of the word-end pattern: a
    contraction, letters, one number, or others; white space is in none."""
    if not len(codes):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    kind, before, after = _neighbours(codes, offsets)
    start = (kind < SPACE) & ((before != kind) | (kind == NUMBER))
    apostrophe = np.flatnonzero((codes == 0x27) & start)
    _split_contractions(codes, offsets, kind, start, apostrophe)
    starts = np.flatnonzero(start)
    rows = np.searchsorted(offsets, starts, "right") - 1
    # A piece also ends where white space begins.
    gap = np.flatnonzero((kind >= SPACE) & (before < SPACE))
    ends = np.minimum(np.append(starts[1:], len(codes)), offsets[rows + 1])
    if len(gap):
        k = np.searchsorted(gap, starts)
        ends = np.minimum(ends, np.where(k < len(gap), gap[np.minimum(k, len(gap) - 1)], len(codes)))
    return starts, ends - starts, rows
