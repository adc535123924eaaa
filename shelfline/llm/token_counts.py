"""Token counts by a compiled finite-state transducer of a byte-level BPE.

A transducer's state is the last token emitted and where it ended; reading on,
it passes to a token that may follow (the pair is stable: no merge crosses
their border before both are built) and emits one more token.  For every end
of a prefix exactly one token can be the last, so from a known state the
machine is deterministic and its count is what merging gives.  Which pairs are
stable is worked out from the merges when a pair is first met, and kept.

Texts are cut into chunks wherever they are.  What the state at a cut is only
the text before could tell, so a chunk's map says, for every state that the
machine can be in at its front, in which states it can be at its end and how
many tokens it emits on the way.  Where a piece of the split pattern ends, all
states become one.  Maps are composed in a tree, in a task over the chunks of
a stretch, and then over the stretches of a text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import code_values, mix64, powers, span_hashes, stored, text_slices
from shelfline.llm.pretokens import byte_level_spans, code_points

#: Characters of a chunk, and of a stretch of a text that one task maps.
CHUNK, STRETCH = 1 << 12, 1 << 20
#: Bytes of pieces handled side by side; longer ones are handled one by one.
LANES = (4, 8, 16, 32)
#: Slots of the caches of stable pairs and of counted pieces; maps of chunks within a piece that are kept.
SLOTS, KEPT_CHUNKS = 1 << 20, 256

#: A place relative to a cut (not after it), and the token that ends there; -1: a piece begins there.
State = tuple[int, int]
#: Tokens emitted from each state at the front to each at the end.
Map = dict[State, dict[State, int]]
Window = tuple[str, str, str]
FRESH: State = (0, -1)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Compiled from a tokenizer's vocabulary and merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model = byte_letters(), file["model"]
        self.special = [t["content"] for t in file["added_tokens"]]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Tokens are numbered in the order in which merging can build them: bytes, then merges.
        names = sorted(letters, key=letters.get)
        number = {name: k for k, name in enumerate(names)}
        left, right = list(range(256)), list(range(256))
        for a, b in merges:
            number.setdefault(a + b, len(number))
            left.append(number[a])
            right.append(number[b])
        tokens = [bytes(letters[c] for c in name) for name in number]
        self.left, self.right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        keys = self.left[256:] << 20 | self.right[256:]
        order = np.argsort(keys)
        self.merge_keys, self.merge_to = keys[order], order + 256
        lens = np.array([len(t) for t in tokens], dtype=np.int64)
        flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        hashes = span_hashes(flat, np.cumsum(lens) - lens, lens)
        order = np.argsort(hashes)
        self.token_hash, self.token = hashes[order], order
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(hashes >> np.uint64(42)).astype(np.int64)] = True
        self.longest, self.size = int(lens.max()), lens.tolist()
        self.merges = {a << 20 | b: 256 + k for k, (a, b) in enumerate(zip(left[256:], right[256:], strict=True))}
        self.lefts_rights, self.pairs, self.chunks = (left, right), {}, {}
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), k)
        self.automaton.make_automaton()
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pair_key = np.full(SLOTS, -1, dtype=np.int64)
        self.pair_ok = np.zeros(SLOTS, dtype=bool)
        self.piece_key = np.zeros(SLOTS, dtype=np.uint64)
        self.piece_n = np.zeros(SLOTS, dtype=np.int32)

    def _stable(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Undoes the later of the two border tokens' merges again and again;
        a merge across the border that comes before both is unstable."""
        a, b = first.copy(), second.copy()
        # The merges that took up a and b; none yet for the whole tokens.
        a_next = np.full(len(a), 1 << 40, dtype=np.int64)
        b_next = a_next.copy()
        ok = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            keys = x << 20 | y
            at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
            across = np.where(self.merge_keys[at] == keys, self.merge_to[at], 1 << 41)
            crossed = (across < a_next[live]) & (across <= b_next[live])
            ok[live[crossed]] = False
            done = crossed | ((x < 256) & (y < 256))
            live, x, y = live[~done], x[~done], y[~done]
            undo_a = x > y
            i, j = live[undo_a], live[~undo_a]
            a_next[i], a[i] = x[undo_a], self.right[x[undo_a]]
            b_next[j], b[j] = y[~undo_a], self.left[y[~undo_a]]
        return ok

    def follows(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each second token may follow each first one."""
        keys = first << 20 | second
        slot = (mix64(keys.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        missing = self.pair_key[slot] != keys
        ok = self.pair_ok[slot]
        if missing.any():
            new, back = np.unique(keys[missing], return_inverse=True)
            found = self._stable(new >> 20, new & ((1 << 20) - 1))
            ok[missing] = found[back]
            slot = (mix64(new.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
            # Of pairs that share a slot one stays, key and answer together.
            _, stays = np.unique(slot, return_index=True)
            self.pair_key[slot[stays]], self.pair_ok[slot[stays]] = new[stays], found[stays]
        return ok

    def _lanes(self, pieces: list[bytes], width: int) -> np.ndarray:
        """Counts of pieces of at most ``width`` bytes, side by side."""
        n = len(pieces)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        last = np.full((width + 1, n), -1, dtype=np.int64)
        count = np.zeros((width + 1, n), dtype=np.int32)
        letters = code_values(data).reshape(n, width).T
        # sums[begin]: of the bytes from there to the present end, as span_hashes adds them up
        sums = np.zeros((width, n), dtype=np.uint64)
        power = powers(width)
        for end in range(1, width + 1):
            for begin in range(end):
                sums[begin] += letters[end - 1] * power[end - 1 - begin]
            open_ = np.flatnonzero(lens >= end)
            for size in range(min(end, self.longest), 0, -1):
                if not len(open_):
                    break
                begin = end - size
                hashes = mix64(sums[begin, open_] + np.uint64(size))
                likely = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.token_hash, hashes[likely]), len(self.token_hash) - 1)
                hit = self.token_hash[at] == hashes[likely]
                lane, token = open_[likely[hit]], self.token[at[hit]]
                if begin and len(lane):
                    ok = self.follows(last[begin, lane], token)
                    lane, token = lane[ok], token[ok]
                if len(lane):
                    last[end, lane], count[end, lane] = token, count[begin, lane] + 1
                    open_ = open_[last[end, open_] < 0]
        return count[lens, np.arange(n)]

    def stable(self, first: int, second: int) -> bool:
        """Whether one token may follow another, as :meth:`_stable` says it."""
        key = first << 20 | second
        known = self.pairs.get(key)
        if known is None:
            a, b, a_next, b_next = first, second, 1 << 40, 1 << 40
            while known is None:
                across = self.merges.get(a << 20 | b, 1 << 41)
                if across < a_next and across <= b_next:
                    known = False
                elif a < 256 and b < 256:
                    known = True
                elif a > b:
                    a_next, a = a, self.lefts_rights[1][a]
                else:
                    b_next, b = b, self.lefts_rights[0][b]
            if len(self.pairs) > 2 * SLOTS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def endings(self, data: bytes) -> list[list[int]]:
        """The tokens that end at each place of ``data``."""
        found: list[list[int]] = [[] for _ in range(len(data) + 1)]
        for at, token in self.automaton.iter(data.decode("latin-1")):
            found[at + 1].append(token)
        return found

    def walk(self, ends: list[list[int]], cut: int, states: list[State], end: int) -> list[dict[int, tuple[int, int]]]:
        """Runs the machine over the places (cut, end] from each of ``states``,
        given as absolute places.  Returns, for each, the last token and the
        tokens emitted at the places from which a token can reach beyond
        ``end``.  States that have become alike go on as one."""
        size, stable = self.size, self.stable
        live = [({place: token}, {place: 0}, [(k, 0)]) for k, (place, token) in enumerate(states)]
        for e in range(cut + 1, end + 1):
            for last, count, _ in live:
                for token in ends[e]:
                    begin = e - size[token]
                    before = last.get(begin)
                    if before is not None and (before < 0 or stable(before, token)):
                        last[e], count[e] = token, count[begin] + 1
                        break
            if (e - cut) % 64 == 0:
                live = self._alike(live, e)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in states]
        for last, count, members in live:
            for k, more in members:
                out[k] = {b: (t, count[b] + more) for b, t in last.items() if b > end - self.longest}
        return out

    def _alike(self, live: list, e: int) -> list:
        """Runs whose places within reach of ``e`` have the same tokens, and
        the same counts but for a constant, as one; what is out of reach goes."""
        groups: dict = {}
        for last, count, members in live:
            near = sorted((b, t) for b, t in last.items() if b > e - self.longest)
            if not near:
                continue
            base = count[near[-1][0]]
            key = tuple((b, t, count[b] - base) for b, t in near)
            if key in groups:
                other, other_base = groups[key]
                other[2].extend((k, more + base - other_base) for k, more in members)
            else:
                groups[key] = (dict(near), {b: count[b] for b, _ in near}, members), base
        return [run for run, _ in groups.values()]

    def open_states(self, ends: list[list[int]], cut: int, known: bool) -> list[State]:
        """The states in which the machine can be at ``cut``, within a piece:
        the last place up to there at which a token ends, and that token (-1:
        the piece's start).  ``ends`` begins with the piece where that is
        ``known``; else somewhere in it, and a token may be there if, as far
        as can be seen, others that may precede it lead there."""
        reach, size = self.longest, self.size
        if known:
            nodes = [(b, t) for b, (t, _) in self.walk(ends, 0, [(0, -1)], cut)[0].items()]
        else:
            before: list[list[int]] = [[] for _ in range(cut + 1)]
            for e in range(1, cut + 1):
                for token in ends[e]:
                    begin = e - size[token]
                    if begin < reach or any(self.stable(t, token) for t in before[begin]):
                        before[e].append(token)
            nodes = [(e, t) for e in range(max(0, cut - reach + 1), cut + 1) for t in before[e]]
        crossing: dict[int, list[int]] = {}
        for e in range(cut + 1, min(cut + reach, len(ends) - 1) + 1):
            for token in ends[e]:
                if e - size[token] <= cut:
                    crossing.setdefault(e - size[token], []).append(token)
        return [(b, t) for b, t in nodes if any(t < 0 or self.stable(t, token) for token in crossing.get(b, ()))]

    def _one(self, piece: bytes) -> int:
        """The count of one long piece."""
        return self.walk(self.endings(piece), 0, [(0, -1)], len(piece))[0][len(piece)][1]

    def pieces(self, pieces: list[bytes]) -> np.ndarray:
        """The count of each piece."""
        out = np.zeros(len(pieces), dtype=np.int32)
        lens = np.array([len(p) for p in pieces], dtype=np.int64)
        low = 0
        for width in LANES:
            at = np.flatnonzero((lens > low) & (lens <= width))
            if len(at):
                out[at] = self._lanes([pieces[k] for k in at.tolist()], width)
            low = width
        for k in np.flatnonzero(lens > low).tolist():
            out[k] = self._one(pieces[k])
        return out

    def span_counts(self, joined: str, codes: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Tokens of each of the pieces ``joined[start:start + len]``; those
        met before are known by their hash."""
        if not len(starts):
            return np.zeros(0, dtype=np.int64)
        keys, place, back = np.unique(span_hashes(codes, starts, lens), return_index=True, return_inverse=True)
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        counts = self.piece_n[slot]
        missing = np.flatnonzero(self.piece_key[slot] != keys)
        if len(missing):
            s, n = starts[place[missing]].tolist(), lens[place[missing]].tolist()
            counts[missing] = self.pieces([joined[a : a + k].encode() for a, k in zip(s, n, strict=True)])
            _, stays = np.unique(slot[missing], return_index=True)
            self.piece_key[slot[missing[stays]]], self.piece_n[slot[missing[stays]]] = keys[missing[stays]], counts[missing[stays]]
        return counts[back].astype(np.int64)

    def state_maps(self, windows: list[Window], chunk: int = CHUNK) -> list[Map]:
        """The map of each window's body: of its chunks' maps, composed.

        A window is (text before, body, text after); the texts around the body
        are as long as ``around``, or as long as there is text.
        """
        joined, codes, offsets = code_points([before + body + after for before, body, after in windows])
        starts, lens, _ = byte_level_spans(codes, offsets)
        stops = starts + lens
        own: list[int] = []
        cuts: list[int] = []
        for k, (before, body, _) in enumerate(windows):
            first = int(offsets[k]) + len(before)
            for c in range(first, first + max(len(body), 1), chunk):
                own.append(k)
                cuts += [c, min(c + chunk, first + len(body))]
        cut, end = np.array(cuts, dtype=np.int64).reshape(-1, 2).T
        # The pieces that are wholly in a chunk; others are open at its cuts.
        low, high = np.searchsorted(starts, cut), np.searchsorted(stops, end, "right")
        inside = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(inside, low[low < high], 1)
        np.add.at(inside, high[low < high], -1)
        whole = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        counts = np.zeros(len(starts) + 1, dtype=np.int64)
        counts[whole + 1] = self.span_counts(joined, codes, starts[whole], lens[whole])
        total = np.cumsum(counts)
        body = np.where(low < high, total[high] - total[np.minimum(low, high)], 0)
        at = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))]).astype(np.int64)
        data = joined.encode()
        found: list[list[Map]] = [[] for _ in windows]
        for i, k in enumerate(own):
            c, e, lo, hi = int(cut[i]), int(end[i]), int(low[i]), int(high[i])
            # Where the text before is cut off, what seems to start there may have started before.
            fake = int(offsets[k]) if len(windows[k][0]) >= self.around[0] else -1
            found[k].append(self._chunk_map(data, at, starts, stops, c, e, lo, hi, int(body[i]), fake))
        return [composed(maps) for maps in found]

    def _chunk_map(self, data, at, starts, stops, c: int, e: int, lo: int, hi: int, n: int, fake: int) -> Map:
        """The map of the characters [c, e): the piece that is open at its
        front from every state it can be in there, the ``n`` tokens of whole
        pieces, and the piece that is open at its end."""
        if c == e:
            return {FRESH: {FRESH: 0}}
        reach = self.longest

        def opened(place: int, piece: int) -> tuple[list[list[int]], int, list[State], int]:
            """Tokens by end from before ``place`` within a piece, where ``place`` is in them, the states there, and where they begin."""
            begin, here = int(at[starts[piece]]), int(at[place])
            from_ = max(begin, here - 3 * reach)
            stop = int(at[stops[piece]])
            ends = self.endings(data[from_ : min(stop, max(int(at[e]), here) + reach)])
            return ends, here - from_, self.open_states(ends[: here - from_ + reach + 1], here - from_, from_ == begin and starts[piece] != fake), from_

        fresh_front = lo < len(starts) and int(starts[lo]) == c
        if lo > hi:  # all within one piece
            begin, here, there = int(at[starts[hi]]), int(at[c]), int(at[e])
            key = data[max(begin, here - 3 * reach) : min(int(at[stops[hi]]), there + reach)], here - max(begin, here - 3 * reach), there - here, begin >= here - 3 * reach and starts[hi] != fake
            if key not in self.chunks:
                ends, place, states, _ = opened(c, hi)
                runs = self.walk(ends, place, states, place + there - here)
                if len(self.chunks) > KEPT_CHUNKS:
                    self.chunks.clear()
                self.chunks[key] = _map(((b - place, t), {(q - place - (there - here), u): m for q, (u, m) in run.items()}) for (b, t), run in zip(states, runs, strict=True))
            return self.chunks[key]
        # Behind the front piece the state is FRESH, whatever it was before.
        front = {FRESH: n}
        if not fresh_front:
            ends, place, states, from_ = opened(c, lo - 1)
            stop = int(at[stops[lo - 1]]) - from_
            runs = self.walk(ends, place, states, stop)
            front = {(b - place, t): run[stop][1] + n for (b, t), run in zip(states, runs, strict=True) if stop in run}
        back = {FRESH: 0}
        if hi < len(starts) and int(starts[hi]) < e:
            begin, there = int(at[starts[hi]]), int(at[e])
            run = self.walk(self.endings(data[begin:there]), 0, [(0, -1)], there - begin)[0]
            back = {(q - (there - begin), u): m for q, (u, m) in run.items()}
        return {state: {to: m + more for to, more in back.items()} for state, m in front.items()}

    @property
    def around(self) -> tuple[int, int]:
        """Characters before and after a body that a window needs."""
        return 3 * self.longest + 8, self.longest + 4

    def parts(self, text: str) -> Iterator[str | None]:
        """The parts of a text between special strings, and None for each of these."""
        if not self.special or not any(s in text for s in self.special):
            yield text
            return
        for k, part in enumerate(self.split.split(text)):
            if k:
                yield None
            if part:
                yield part

    def windows(self, text: str, most: int) -> Iterator[Window | None]:
        """A text as windows of at most ``most`` characters; None: a special string."""
        before, after = self.around
        for part in self.parts(text):
            if part is None:
                yield None
            else:
                for i in range(0, max(len(part), 1), most):
                    yield part[max(0, i - before) : i], part[i : i + most], part[i + most : i + most + after]

    def maps_of(self, windows: list[Window | None], chunk: int = CHUNK) -> list[Map]:
        maps = iter(self.state_maps([w for w in windows if w is not None], chunk))
        return [{FRESH: {FRESH: 1}} if w is None else next(maps) for w in windows]

    def counts(self, texts: list[str], chunk: int = CHUNK, most: int = STRETCH) -> list[int]:
        """Tokens of each text; a special string in it is one token."""
        windows = [list(self.windows(t, most)) for t in texts]
        maps = iter(self.maps_of([w for ws in windows for w in ws], chunk))
        return [composed([next(maps) for _ in ws])[FRESH][FRESH] for ws in windows]


def _map(pairs) -> Map:
    return {state: to for state, to in pairs if to}


def compose(one: Map, two: Map) -> Map:
    """The map of what ``one`` reads followed by what ``two`` reads.  Of all
    ways between two states at most one is a tokenization."""
    out = {}
    for state, reached in one.items():
        to = {last: n + m for middle, n in reached.items() for last, m in two.get(middle, {}).items()}
        if to:
            out[state] = to
    return out


def composed(maps: list[Map]) -> Map:
    """All maps in their order, composed in a tree."""
    while len(maps) > 1:
        maps = [compose(maps[k], maps[k + 1]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0] if maps else {FRESH: {FRESH: 0}}


def packed(map_: Map) -> bytes:
    rows = [(*state, *to, n) for state, reached in map_.items() for to, n in reached.items()]
    return np.array(rows, dtype="<i8").tobytes()


def unpacked(data: bytes) -> Map:
    out: Map = {}
    for a, b, c, d, n in np.frombuffer(data, dtype="<i8").reshape(-1, 5).tolist():
        out.setdefault((a, b), {})[c, d] = n
    return out


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


MAPPED = "row bigint, doc_id bigint, n_bytes bigint, place int, map binary, before string, body string, after string"


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row's whole text.

    ``tokenizer`` is the path of a byte-level BPE's JSON file, there on every
    executor.  A null text counts as empty: no token.  Repeated rows are
    counted each; a null id stays null; other columns play no part; an empty
    table gives no row.  A text's first STRETCH characters are mapped where it
    is read, further stretches of it are dealt to other tasks; all maps of a
    text meet to be composed.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(MAPPED))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            ids, numbers = batch["doc_id"].to_pylist(), batch["row"].to_pylist()
            for first, _, data, offsets in text_slices(batch["text"]):
                whole = data.tobytes()
                bounds = offsets.tolist()
                here, later = [], []
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), first):
                    windows, seen = [], 0
                    for place, window in enumerate(machine.windows(whole[a:b].decode(), STRETCH)):
                        seen += len(window[1]) if window else 0
                        if seen <= STRETCH:
                            windows.append(window)
                        else:
                            text = dict(zip(("before", "body", "after"), window, strict=True)) if window else {"map": packed({FRESH: {FRESH: 1}})}
                            later.append({"row": numbers[k], "place": place} | text)
                    here.append((k, b - a, windows))
                maps = iter(machine.maps_of([w for _, _, windows in here for w in windows]))
                rows = [{"row": numbers[k], "doc_id": ids[k], "n_bytes": n, "place": 0, "map": packed(composed([next(maps) for _ in windows]))} for k, n, windows in here]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                for row in later:
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in batches:
            for row in batch.to_pylist():
                map_ = packed(machine.maps_of([(row["before"], row["body"], row["after"])])[0])
                yield pa.RecordBatch.from_arrays([pa.array([row["row"]]), pa.array([row["place"]], pa.int32()), pa.array([map_])], names=["row", "place", "map"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, maps = None, []

        def end() -> list[tuple]:
            return [(now["doc_id"], now["n_bytes"], composed(maps)[FRESH][FRESH])] if now else []

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or row["row"] != now["row"]:
                    done += end()
                    now, maps = row, []
                maps.append(unpacked(row["map"]))
            yield _counted(done)
        yield _counted(end())

    texts = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").withColumn("row", F.monotonically_increasing_id())
    found = stored(texts.mapInArrow(read, MAPPED), "state-maps")
    others = found.where("body is not null").select("row", "place", "before", "body", "after").repartition("row", "place")
    others = others.mapInArrow(dealt, "row bigint, place int, map binary").selectExpr("row", "cast(null as bigint) as doc_id", "cast(null as bigint) as n_bytes", "place", "map")
    maps = found.where("map is not null").select("row", "doc_id", "n_bytes", "place", "map").unionByName(others)
    return maps.repartition("row").sortWithinPartitions("row", "place").mapInArrow(met, COUNTED)


COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint"


def _counted(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.int64()) for k in range(3)], names=["doc_id", "n_bytes", "n_tokens"])
