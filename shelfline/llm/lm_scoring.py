"""Language-model scoring by class-based n-grams (Brown classes).

Every word of the training text has a class.  The start is found on the
driver: exchange clustering of the most frequent words, and of the endings of
all others, moves these units between classes while the likelihood of the
class bigrams grows.  Then every word moves on its own: the classes on either
side of each word are counted over all training text, and it goes to the class
that makes them likeliest.  Only words unseen in training take a
class by their ending.  A word's probability in its class is that of its class
after the class before, times that of the word within its class, both
smoothed; with the word's smoothed share of all tokens it is mixed, MIX to
1 - MIX.

Words are known by a 64-bit hash.  Counts cover all training text.  A word's
count and class are broadcast for the most frequent words (at most HELD) and
joined for all others; which way a word goes changes no class and no score.
While words move, all neighbours are seen in the classes of the start, where
every word but the WORDS most frequent is in that of its ending; transitions
and scores are those of every word's own class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import mix64, most_frequent, stored, words_of

#: Words that are units of their own at the start; units of endings; classes; sweeps of its exchange.
WORDS, ENDINGS, CLASSES, SWEEPS = 1024, 256, 64, 8
#: Words that a task merges when they move, about, and the most such tasks.
MERGED, MERGERS = 50_000, 100_000
#: The most words, beside those of the start, whose counts and classes are broadcast (24 bytes each).
HELD = 1 << 19
#: Distinct words (or words beside a class) a task gathers before it passes them on.
GATHERED = 1 << 19
#: Classes beside a word: the class after it, or SIDE + the class before it; the last class is the end of a text.
SIDE = CLASSES + 1
#: Smoothing of class transitions.
TRANSITION_PRIOR = 0.5
#: The class model's share in a word's probability; 0.7 and 0.8 were best on a
#: fold that is neither learned from nor scored.
MIX = 0.75


def _endings(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The unit of each word's last three bytes."""
    key = np.zeros(len(starts), dtype=np.uint64)
    for back in (1, 2, 3):
        at = starts + lens - back
        key = key << np.uint64(8) | np.where(lens >= back, data[np.maximum(at, 0)], 0).astype(np.uint64)
    return (mix64(key) >> np.uint64(56)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (its hash), n and ending of every distinct word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, at, back = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([h[1] for h in held])).astype(np.int64), np.concatenate([h[2] for h in held])[at]

        def out(keys, n, ending) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n), pa.array(ending.astype(np.int32))], names=["word", "n", "ending"])

        for batch in batches:
            for _, _, data, starts, lens, _, hashes in words_of(batch["text"]):
                keys, at, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((keys, n, _endings(data, starts[at], lens[at])))
                if sum(len(h[0]) for h in held) > 2 * GATHERED:
                    held = [merged()]
                    if len(held[0][0]) > GATHERED:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    counts = docs.selectExpr(f"`{text_col}` as text").mapInArrow(rows, "word bigint, n bigint, ending int")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.max("ending").alias("ending"))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit: units in order of frequency move, one after
    another, to the class in which the class bigrams are likeliest; ties keep
    the lower class.  The last unit (the end of a text) is a class of its own."""
    n = len(bigrams)
    b = bigrams.astype(np.float64)
    weight = b.sum(axis=0) + b.sum(axis=1)
    order = np.argsort(-weight[:-1], kind="stable")
    of = np.zeros(n, dtype=np.int64)
    of[order] = np.arange(n - 1) % classes
    of[n - 1] = classes
    k = classes + 1
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    after, before = b @ member, b.T @ member  # of each unit, by class of the neighbour
    table = member.T @ after
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(sweeps):
        moved = 0
        for u in order.tolist():
            c, own = of[u], b[u, u]
            right, left = after[u].copy(), before[u].copy()
            right[c] -= own
            left[c] -= own
            table[c] -= right
            table[:, c] -= left
            table[c, c] -= own
            rows, cols = table.sum(axis=1), table.sum(axis=0)
            gain = (f(table + right) - f(table)).sum(axis=1) + (f(table + left[:, None]) - f(table)).sum(axis=0)
            d = np.diag(table)
            gain += f(d + right + left + own) - f(d + right) - f(d + left) + f(d)
            r, s = right.sum() + own, left.sum() + own
            gain -= f(rows + r) - f(rows) + f(cols + s) - f(cols)
            best = int(np.argmax(gain[:classes]))
            if best != c and gain[best] <= gain[c] + 1e-9:
                best = c
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            if best != c:
                moved += 1
                of[u] = best
                after[:, c] -= b[:, u]
                after[:, best] += b[:, u]
                before[:, c] -= b[u]
                before[:, best] += b[u]
        if not moved:
            break
    return of


@dataclass
class ClassModel:
    """What every task needs; its size has fixed bounds."""

    words: np.ndarray  # sorted hashes of the words that are held
    counts: np.ndarray
    classes: np.ndarray  # of these words
    endings: np.ndarray  # the class of unseen words of each ending
    ends: int  # training texts
    tokens: int
    distinct: int
    least: int  # words of this count or more are held
    log_next: np.ndarray | None = None  # [class before, class], log10
    log_total: np.ndarray | None = None  # log10 of the smoothed words of each class

    def steps(self) -> np.ndarray:
        """[class before, class]: log10 of a word's probability over its
        smoothed count, mixed."""
        return np.log10(MIX * 10 ** (self.log_next - self.log_total) + (1 - MIX) / (self.tokens + self.distinct + 1))


def _find(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each word is among the sorted ``words``; -1: nowhere."""
    if not len(words):
        return np.full(len(hashes), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, -1)


def _sequences(rows: np.ndarray, of: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, unit (or class) before and own unit of each token of ``n`` texts,
    ends included; what comes before the first is an end."""
    row = np.concatenate([rows, np.arange(n)])
    order = np.argsort(row, kind="stable")
    row, now = row[order], np.concatenate([of, np.full(n, end)])[order]
    before = np.concatenate([[end], now[:-1]])
    return row, before, now


def bigrams(docs: DataFrame, words: np.ndarray, units: np.ndarray, text_col: str = "text") -> np.ndarray:
    """Counts of neighbouring units over all texts, a bounded table: the units
    of ``words``, those of endings for all others, and the end as the last."""
    n_units = WORDS + ENDINGS + 1
    held = docs.sparkSession.sparkContext.broadcast((words, units))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, units = held.value
        table = np.zeros(n_units * n_units, dtype=np.int64)
        for batch in batches:
            for first, last, data, starts, lens, row, hashes in words_of(batch["text"]):
                at = _find(words, hashes)
                unit = np.where(at >= 0, units[at] if len(units) else 0, WORDS + _endings(data, starts, lens))
                _, before, now = _sequences(row, unit, last - first, n_units - 1)
                keys, n = np.unique(before * n_units + now, return_counts=True)
                table[keys] += n
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["pair", "n"])

    return _table(docs.selectExpr(f"`{text_col}` as text").mapInArrow(rows, "pair int, n bigint"), n_units)


def _table(pairs: DataFrame, n: int) -> np.ndarray:
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(n * n, dtype=np.int64)
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(n, n)


#: The words of one part of a task's: hash, ending, how many classes beside it, and each of these with its count.
BLOCK = "part int, words binary, endings binary, sizes binary, beside binary, times binary"


def _runs(word: np.ndarray, beside: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (word, class beside it) added up, in order of both."""
    order = np.lexsort((beside, word))
    word, beside, times = word[order], beside[order], times[order]
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (beside[1:] != beside[:-1])]) if len(word) else np.zeros(0, dtype=np.int64)
    return word[first], beside[first], np.add.reduceat(times, first) if len(first) else times


def _beside(docs: DataFrame, words: np.ndarray, classes: np.ndarray, word_endings: np.ndarray, endings: np.ndarray, parts: int, text_col: str) -> DataFrame:
    """How often each class is beside each word, as each task has gathered it:
    one row a part of the words."""
    held = docs.sparkSession.sparkContext.broadcast((words, classes, word_endings, endings))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, word_endings, endings = held.value
        # Of held words the place among them stands for the word; of the others the hash.
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        rare: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
            return keys, np.bincount(back, weights=np.concatenate([k[1] for k in kept])).astype(np.uint32)

        def out() -> Iterator[pa.RecordBatch]:
            keys, times = merged() if kept else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32))
            kept.clear()
            word, beside, ending = (words[keys >> 8], keys.astype(np.uint8), word_endings[keys >> 8]) if len(keys) else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint8))
            del keys
            if rare:
                every, classed, ones, of = (np.concatenate([r[k] for r in rare]) for k in range(4))
                w, b, n = _runs(every, classed, ones)
                some, at = np.unique(every, return_index=True)
                e = of[at][np.searchsorted(some, w)]
                word, beside, times, ending = np.concatenate([word, w]), np.concatenate([beside, b]), np.concatenate([times, n]), np.concatenate([ending, e])
                rare.clear()
            part = (word % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                some = order[bounds[k] : bounds[k + 1]]
                w = word[some]
                first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                size = np.diff(np.append(first, len(w)))
                binary = [w[first].astype("<u8"), ending[some][first], size.astype("u1"), beside[some], times[some].astype("<u4")]
                yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), *(pa.array([x.tobytes()], type=pa.binary()) for x in binary)], names=["part", "words", "endings", "sizes", "beside", "times"])

        for batch in batches:
            for _, _, data, starts, lens, row, hashes in words_of(batch["text"]):
                if not len(hashes):
                    continue
                at, ending = _find(words, hashes), _endings(data, starts, lens)
                of = np.where(at >= 0, classes[at] if len(words) else 0, endings[ending])
                first, last = np.r_[True, row[1:] != row[:-1]], np.r_[row[1:] != row[:-1], True]
                after = np.where(last, CLASSES, np.r_[of[1:], CLASSES])
                before = np.where(first, CLASSES, np.r_[CLASSES, of[:-1]]) + SIDE
                there = at >= 0
                keys, times = np.unique(np.concatenate([at[there] << 8 | after[there], at[there] << 8 | before[there]]), return_counts=True)
                kept.append((keys, times.astype(np.uint32)))
                other = ~there
                word, beside, e = np.tile(hashes[other], 2), np.concatenate([after[other], before[other]]).astype(np.uint8), np.tile(ending[other], 2).astype(np.uint8)
                rare.append((word, beside, np.ones(len(word), dtype=np.uint32), e))
                if sum(len(k[0]) for k in kept) > 2 * GATHERED:
                    kept[:] = [merged()]
                if sum(len(k[0]) for k in kept) + sum(len(r[0]) for r in rare) > 4 * GATHERED:
                    yield from out()
        yield from out()

    return docs.selectExpr(f"`{text_col}` as text").mapInArrow(rows, BLOCK)


def moved(beside: DataFrame, table: np.ndarray, words: np.ndarray, classes: np.ndarray, endings: np.ndarray) -> DataFrame:
    """word, n, ending and class of every word: the class in which the classes
    beside it are likeliest, where its own class counts without it; ties keep
    the lower class.  ``beside`` holds all rows of a part together."""
    held = beside.sparkSession.sparkContext.broadcast((table.astype(np.float64), words, classes, endings))

    def best(table, own, row, beside, times) -> np.ndarray:
        logs, size = np.log(table + TRANSITION_PRIOR), table.sum(axis=1)
        total = np.log(size + SIDE * TRANSITION_PRIOR)
        counts = np.zeros((len(own), 2 * SIDE))
        counts[row, beside] = times
        after, before = counts[:, :SIDE], counts[:, SIDE:]
        n = after.sum(axis=1)
        gain = after @ logs[:CLASSES].T + before @ logs[:, :CLASSES] - 2 * n[:, None] * total[:CLASSES]
        without = np.where(beside < SIDE, table[own[row], beside % SIDE], table[beside % SIDE, own[row]]) - times
        alone = np.bincount(row, weights=times * np.log(np.maximum(without, 0) + TRANSITION_PRIOR), minlength=len(own))
        gain[np.arange(len(own)), own] = alone - 2 * n * np.log(np.maximum(size[own] - n, 0) + SIDE * TRANSITION_PRIOR)
        return gain.argmax(axis=1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, classes, endings = held.value
        now, kept, seen = None, [], []

        def end() -> Iterator[pa.RecordBatch]:
            if not kept:
                return
            word, beside, times = _runs(*(np.concatenate([k[i] for k in kept]) for i in range(3)))
            every, at = np.unique(np.concatenate([s[0] for s in seen]), return_index=True)
            ending = np.concatenate([s[1] for s in seen])[at].astype(np.int64)
            row = np.searchsorted(every, word)
            place = _find(words, every)
            own = np.where(place >= 0, classes[place] if len(words) else 0, endings[ending])
            n = np.bincount(row, weights=np.where(beside < SIDE, times, 0), minlength=len(every)).astype(np.int64)
            for k in range(0, len(every), 20_000):
                some = slice(*np.searchsorted(row, [k, k + 20_000]))
                of = best(table, own[k : k + 20_000], row[some] - k, beside[some].astype(np.int64), times[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (every[k : k + 20_000].view(np.int64), n[k : k + 20_000], ending[k : k + 20_000].astype(np.int32), of.astype(np.int32))], names=["word", "n", "ending", "class"]
                )

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now:
                    yield from end()
                    now, kept, seen = r["part"], [], []
                word, size = np.frombuffer(r["words"], dtype="<u8"), np.frombuffer(r["sizes"], dtype="u1")
                kept.append((np.repeat(word, size), np.frombuffer(r["beside"], dtype="u1"), np.frombuffer(r["times"], dtype="<u4").astype(np.int64)))
                seen.append((word, np.frombuffer(r["endings"], dtype="u1")))
                if sum(len(k[0]) for k in kept) > 2 * GATHERED and len(kept) > 1:
                    kept = [_runs(*(np.concatenate([k[i] for k in kept]) for i in range(3)))]
                    word, at = np.unique(np.concatenate([s[0] for s in seen]), return_index=True)
                    seen = [(word, np.concatenate([s[1] for s in seen])[at])]
        yield from end()

    return beside.mapInArrow(rows, CLASSED)


CLASSED = "word bigint, n bigint, ending int, class int"


def _dropped(table: DataFrame) -> None:
    """Frees the disk of a stored table that is not read again."""
    jvm, files = table.sparkSession._jvm, table.inputFiles()
    if files:
        path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def cluster(docs: DataFrame, text_col: str = "text") -> tuple[ClassModel, DataFrame]:
    """The classes of all words of ``docs``: a model without transitions, and
    the table of all words (word, n, ending, class).

    To the driver come at most HELD + WORDS words and the unit bigrams of the
    start.  All words move at once, by the classes of the start; a second sweep
    made held-out texts less likely.
    """
    counts = stored(word_counts(docs, text_col), "word-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    _, least = most_frequent(counts, "n", HELD)
    # The words of the start are held whatever their counts.
    is_held = (F.col("n") >= least) | F.col("word").isin(top)
    frequent = counts.where(is_held).toArrow()
    words, n, word_endings = (frequent[c].to_numpy() for c in ("word", "n", "ending"))
    words = words.view(np.uint64)
    order = np.argsort(words)
    words, n, word_endings = words[order], n[order], word_endings[order].astype(np.uint8)
    units = WORDS + word_endings.astype(np.int64)
    units[np.searchsorted(words, np.array(top, dtype=np.int64).view(np.uint64))] = np.arange(len(top))
    seed = bigrams(docs, words, units, text_col)
    of = exchange(seed, CLASSES)
    ends = int(seed[-1].sum())
    member = np.eye(SIDE)[of]
    table, endings, classes = member.T @ seed @ member, of[WORDS : WORDS + ENDINGS], of[units]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MERGERS, -(-distinct // MERGED) + tokens // (100 * MERGED)))
    beside = _beside(docs, words, classes, word_endings, endings, parts, text_col).repartition(parts, "part").sortWithinPartitions("part")
    classed = stored(moved(beside, table, words, classes, endings), "classes")
    _dropped(counts)
    found = classed.where(is_held).select("word", "class").toArrow()
    classes = found["class"].to_numpy()[np.argsort(found["word"].to_numpy().view(np.uint64))].astype(np.int64)
    # An unseen word is like most words of its ending.
    kinds, endings = np.zeros(ENDINGS), endings.copy()
    for r in classed.groupBy("ending", "class").count().orderBy("ending", "class").collect():
        if r["count"] > kinds[r.ending]:
            kinds[r.ending], endings[r.ending] = r["count"], r["class"]
    return ClassModel(words, n, classes, endings, ends, tokens + ends, distinct + (1 if ends else 0), least), classed


ENCODED = "doc_id bigint, extra boolean, n_tokens bigint, known bigint, logs double, rare array<bigint>, sequence binary"
#: In a sequence, what marks a word that is not held; the rest is the class of its ending.
RARE = 128


def encode(docs: DataFrame, model: ClassModel, classed: DataFrame, extra: Column, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as the sequence of its words' classes (one byte each), in a
    written table: doc_id, extra (passed through), n_tokens, known, logs (of
    counts + 1) and sequence."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = held.value
        logs_of = np.log10(m.counts + 1.0)
        for batch in batches:
            for first, last, data, starts, lens, row, hashes in words_of(batch["text"]):
                n = last - first
                at = _find(m.words, hashes)
                there = at >= 0
                of = m.endings[_endings(data, starts, lens)] + RARE
                of[there] = m.classes[at[there]]
                logs = np.bincount(row[there], weights=logs_of[at[there]], minlength=n) + math.log10(m.ends + 1)
                n_known, n_words = np.bincount(row[there], minlength=n), np.bincount(row, minlength=n)
                ends = np.concatenate([[0], np.cumsum(n_words - n_known)]).astype(np.int32)
                bounds = np.concatenate([[0], np.cumsum(n_words)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, n), batch["extra"].slice(first, n), pa.array(n_words + 1), pa.array(n_known + (1 if m.ends else 0)), pa.array(logs),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[~there].view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(of.astype(np.uint8).tobytes())]),
                    ],
                    names=["doc_id", "extra", "n_tokens", "known", "logs", "rare", "sequence"],
                )

    out = docs.select((F.lit(None) if id_col is None else F.col(id_col)).cast("bigint").alias("doc_id"), extra.alias("extra"), F.col(text_col).alias("text")).mapInArrow(rows, ENCODED)
    out = stored(out.withColumn("row", F.monotonically_increasing_id()), "sequences")
    words = out.select("row", F.posexplode("rare").alias("place", "word"))
    found = words.join(classed.where(F.col("n") < model.least).select("word", "n", "class"), "word")
    rest = found.groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"), F.count("*").alias("more_known"), F.collect_list(F.struct("place", "class")).alias("found")
    )

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, found = batch["sequence"].cast(pa.large_binary()), batch["found"]
            n = len(sequence)
            offsets = np.frombuffer(sequence.buffers()[1], dtype=np.int64)[sequence.offset : sequence.offset + n + 1]
            data = sequence.buffers()[2]
            of = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]].copy() if data is not None else np.zeros(0, dtype=np.uint8)
            rare = np.flatnonzero(of >= RARE)
            of[rare] -= RARE
            there = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if len(there):
                some = found.take(pa.array(there))
                pairs, size = some.flatten(), some.value_lengths().to_numpy()
                start = np.searchsorted(rare, offsets[:-1][there] - offsets[0])
                of[rare[np.repeat(start, size) + pairs.field("place").to_numpy()]] = pairs.field("class").to_numpy()
            bounds = (offsets - offsets[0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "extra", "n_tokens", "known", "logs")), pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(of.tobytes())])],
                names=["doc_id", "extra", "n_tokens", "known", "logs", "sequence"],
            )

    # Both sides grow with the documents: the same way at every size.
    both = out.drop("rare").join(rest.hint("merge"), "row", "left").select(
        "doc_id", "extra", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("known"), (F.col("logs") + F.coalesce("more_logs", F.lit(0.0))).alias("logs"), "sequence", "found"
    )
    done = stored(both.mapInArrow(whole, "doc_id bigint, extra boolean, n_tokens bigint, known bigint, logs double, sequence binary"), "class-sequences")
    _dropped(out)
    return done


def _read(sequence: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, class before and class of each token of class sequences."""
    sequence = sequence.cast(pa.large_binary())
    n = len(sequence)
    offsets = np.frombuffer(sequence.buffers()[1], dtype=np.int64)[sequence.offset : sequence.offset + n + 1]
    data = sequence.buffers()[2]
    of = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return _sequences(np.repeat(np.arange(n), np.diff(offsets)), of.astype(np.int64), n, CLASSES)


def fit(model: ClassModel, classed: DataFrame, encoded: DataFrame) -> ClassModel:
    """``model`` with the transitions of its training texts, given encoded."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIDE * SIDE, dtype=np.int64)
        for batch in batches:
            _, before, now = _read(batch["sequence"])
            table += np.bincount(before * SIDE + now, minlength=SIDE * SIDE)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], names=["pair", "n"])

    transitions = _table(encoded.select("sequence").mapInArrow(rows, "pair int, n bigint"), SIDE) + TRANSITION_PRIOR
    totals = np.zeros(SIDE)
    totals[CLASSES] = model.ends + 1
    for r in classed.groupBy("class").agg((F.sum("n") + F.count("*")).alias("n")).collect():
        totals[r["class"]] = r.n
    return replace(model, log_next=np.log10(transitions / transitions.sum(axis=1, keepdims=True)), log_total=np.log10(totals + 1))


def train(docs: DataFrame, text_col: str = "text") -> tuple[ClassModel, DataFrame]:
    """The model of all of ``docs``, and the table of all their words (word, n,
    ending, class)."""
    model, classed = cluster(docs, text_col)
    encoded = encode(docs, model, classed, F.lit(True), None, text_col)
    return fit(model, classed, encoded), classed


SCORED = "doc_id bigint, extra boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_encoded(encoded: DataFrame, model: ClassModel) -> DataFrame:
    """What :func:`score` returns, of texts that are encoded."""
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ClassModel = held.value
        steps, all_tokens = m.steps(), math.log10(m.tokens + m.distinct + 1)
        for batch in batches:
            row, before, now = _read(batch["sequence"])
            n = batch.num_rows
            logs = batch["logs"].to_numpy()
            score = logs + np.bincount(row, weights=steps[before, now], minlength=n)
            base = logs - batch["n_tokens"].to_numpy() * all_tokens
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "extra", "n_tokens", "known")), pa.array(np.full(n, m.tokens)), pa.array(base), pa.array(score)],
                names=["doc_id", "extra", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return encoded.mapInArrow(rows, SCORED)


def score(docs: DataFrame, model: ClassModel, classed: DataFrame, extra: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, extra (passed through), n_tokens, n_known, train_tokens,
    base_score and score of each row: log10 probabilities of the whole text
    under smoothed word counts alone, and under the class model mixed with them.

    A null text counts as empty: its end alone.  A text is scored whole,
    however long; a task holds the words of a slice of texts, or of one long
    one.  Repeated rows are scored each; equal texts score alike.  Without any
    training text every word is unknown; an empty table gives no row.  Other
    columns play no part.
    """
    return score_encoded(encode(docs, model, classed, extra, id_col, text_col), model)


def train_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`score` of all of ``docs``, learned from those that are not
    ``held_out`` (as ``extra``); every text is encoded once for both."""
    model, classed = cluster(docs.where(~held_out), text_col)
    encoded = encode(docs, model, classed, held_out, id_col, text_col)
    return score_encoded(encoded, fit(model, classed, encoded.where("not extra")))
