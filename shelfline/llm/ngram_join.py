"""N-gram Jaccard self-join of documents, and the groups its links form.

A document's set holds its distinct word n-grams (64-bit hashes).  All sets are
put in one global order, frequent n-grams last.  Two sets that link share some
n-grams of their prefixes, so documents meet in groups by such n-grams.  A
document that shares too few of them with others can have no link and leaves;
so does it leave a group that gives too few of them.

Within a group the sets go into a trie, and a set finds its partners by walking
it: what sets share of a path is intersected once, and a subtree is pruned
where the n-grams that remain cannot make up the overlap needed.  Partners
already in one component need not be compared.

Equal sets are joined once.  A group too large for a task is split; every part
holds the group's pivot.  What is not in the pivot's component meets in a
second round, by n-grams that are rare among the members of split groups: so a
passage that many unlike documents share costs the n-grams of their prefixes,
not pairs of parts.  What is still outside in a group that is split again meets
all parts of it, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import free_names, mix64, most_frequent, stored, words_of

#: The most n-grams whose frequency the global order knows (24 bytes each, broadcast).
FREQUENT = 1 << 17
#: Documents of a task that share an n-gram before it can count as frequent.
SEEN = 4
#: N-grams of a task that are held while it counts them (24 bytes each, some
#: five times that while they are added up).
HELD_GRAMS = 1_000_000
#: Members of a part of a group, and n-grams of all its sets, about.
PART_SETS, PART_GRAMS = 1000, 2_000_000
#: Rows of one n-gram that are held before its group is settled.
HELD_ROWS = 500_000
#: Counters of the second round's order (8 bytes each, broadcast; only the order depends on them).
SLOTS = 1 << 20
#: The most bits of the filter that spares documents without partners.
FILTER_BITS = 1 << 27


@dataclass(frozen=True)
class Rule:
    """Sets of ``n``-word n-grams link when ``den`` * intersection is at least
    ``num`` * union."""

    n: int
    num: int
    den: int

    def surplus(self, size):
        """How many n-grams of prefixes linked sets of at least this size
        share; prefixes are longer by so much than those that share one."""
        return 1 + size * 3 // 100

    def prefix(self, size: np.ndarray) -> np.ndarray:
        return np.minimum(size, size - -(-self.num * size // self.den) + self.surplus(size))

    def needed(self, a, b):
        """The least intersection of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: first and last row, and of each n-gram of each set its row
    and its hash, in order of both."""
    for first, last, _, _, _, rows, hashes in words_of(column):
        size = np.bincount(rows, minlength=last - first)
        grams = np.zeros(len(hashes), dtype=np.uint64)
        count = len(hashes)
        for k in range(n):
            grams[: count - k] = mix64(grams[: count - k] * np.uint64(0x9FB21C651E98DF25) + hashes[k:])
        whole = np.zeros(count, dtype=bool)
        if count >= n:
            whole[: count - n + 1] = rows[: count - n + 1] == rows[n - 1 :]
        row, gram = rows[whole], grams[whole]
        # A shorter text is one sequence, of its length.
        begins = np.cumsum(size) - size
        short = np.flatnonzero((size > 0) & (size < n))
        if len(short):
            one = np.full(len(short), 17, dtype=np.uint64)
            for k in range(n - 1):
                has = size[short] > k
                one[has] = mix64(one[has] * np.uint64(0xA24BAED4963EE407) + hashes[begins[short[has]] + k])
            row, gram = np.concatenate([row, short]), np.concatenate([gram, one])
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        yield first, last, row[fresh], gram[fresh]


def _read(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")


def _profile(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of documents (doc, n, digest of the set) and of n-grams that a
    task has met often (gram, seen, doc: the smallest that has it)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n", "digest", "gram", "seen"]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            gram, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            low = np.full(len(gram), np.iinfo(np.int64).max)
            np.minimum.at(low, back, np.concatenate([h[2] for h in held]))
            return gram, np.bincount(back, weights=np.concatenate([h[1] for h in held])).astype(np.int64), low

        for batch in batches:
            ids = batch["doc"].to_numpy()
            for first, last, row, gram in _sets(batch["text"], rule.n):
                size = np.bincount(row, minlength=last - first)
                ends = np.cumsum(size).tolist()
                raw = gram.tobytes()
                digests = [hashlib.blake2b(raw[8 * (e - k) : 8 * e], digest_size=16).digest() for e, k in zip(ends, size.tolist(), strict=True)]
                none = pa.nulls(last - first, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:last]), pa.array(size), pa.array(digests, type=pa.binary()), none, none], names=names)
                doc = ids[first:last][row]
                order = np.lexsort((doc, gram))
                gram, doc = gram[order], doc[order]
                begin = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, dtype=np.int64)
                held.append((gram[begin], np.diff(np.append(begin, len(gram))), doc[begin]))
                if sum(len(h[0]) for h in held) > HELD_GRAMS:
                    # What was met once is let go, which can only change the order.
                    gram, seen, low = merged()
                    held = [(gram[seen > 1], seen[seen > 1], low[seen > 1])]
        if held:
            gram, seen, low = merged()
            often = seen >= SEEN
            n = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(low[often]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(gram[often].view(np.int64)), pa.array(seen[often])], names=names
            )

    return docs.mapInArrow(rows, "doc bigint, n bigint, digest binary, gram bigint, seen bigint")


class Order:
    """The global order: by frequency, of those that have one, then by hash."""

    def __init__(self, grams: np.ndarray, seen: np.ndarray, docs: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.seen, self.docs = grams[order], seen[order], docs[order]
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.grams >> np.uint64(42)).astype(np.int64)] = True

    def look(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each n-gram is among the frequent ones (-1: nowhere), and how often it is there."""
        at = self.find(grams)
        return at, np.where(at >= 0, self.seen[at] if len(self.seen) else 0, 0)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Where each n-gram is among the frequent ones; -1: nowhere."""
        out = np.full(len(grams), -1, dtype=np.int64)
        if len(self.grams):
            likely = np.flatnonzero(self.maybe[(grams >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.grams, grams[likely]), len(self.grams) - 1)
            out[likely] = np.where(self.grams[at] == grams[likely], at, -1)
        return out


    def frequency(self, grams: np.ndarray) -> np.ndarray:
        """How often n-grams are known to be there; 0: not among the frequent ones."""
        return self.look(grams)[1]


class Counters:
    """An order of all n-grams of some documents: by the counter that an
    n-gram shares with others, then by hash.  A counter is never below the
    n-gram's own number of sets, so what many share comes late."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @staticmethod
    def slot(grams: np.ndarray) -> np.ndarray:
        return (mix64(grams ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(SLOTS)).astype(np.int64)

    def look(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.full(len(grams), -1, dtype=np.int64), self.frequency(grams)

    def frequency(self, grams: np.ndarray) -> np.ndarray:
        return self.table[self.slot(grams)]


def _counters(docs: DataFrame, rule: Rule, only) -> Counters:
    """The counters over the sets of what ``only`` leaves of ``docs``; each
    task adds up its own."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SLOTS, dtype=np.int64)
        for batch in map(only, batches):
            for _, _, _, gram in _sets(batch["text"], rule.n):
                slots, times = np.unique(Counters.slot(gram), return_counts=True)
                table[slots] += times
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(table[some])], names=["slot", "times"])

    summed = docs.mapInArrow(rows, "slot int, times bigint").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    table = np.zeros(SLOTS, dtype=np.int64)
    table[summed["slot"].to_numpy()] = summed["times"].to_numpy()
    return Counters(table)


def _memberships(docs: DataFrame, rule: Rule, order, only=lambda batch: batch) -> DataFrame:
    """grp, doc and grams: the groups in which documents with a common n-gram
    of their prefixes meet, each named by its smallest document, and how many
    n-grams of the document's prefix lead there; of what ``only`` leaves."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Order | Counters = order.value
        for batch in map(only, batches):
            ids = batch["doc"].to_numpy()
            for first, last, row, gram in _sets(batch["text"], rule.n):
                if not len(row):
                    continue
                at, seen = known.look(gram)
                if seen.any():
                    by = np.lexsort((gram, seen, row))
                    row, gram, at = row[by], gram[by], at[by]
                size = np.bincount(row, minlength=last - first)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                take = place < rule.prefix(size)[row]
                row, gram, at, place = row[take], gram[take], at[take], place[take]
                doc, n = ids[first:last][row], size[row]
                often = at >= 0
                pair, times = np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=np.int64)
                if often.any():
                    pair, times = np.unique(np.stack([known.docs[at[often]], doc[often]]), axis=1, return_counts=True)
                light = ~often
                ones = int(light.sum())
                # Rows of frequent n-grams name their group and go anywhere; others meet by n-gram.
                key = np.concatenate([gram[light].view(np.int64), mix64(pair[1].astype(np.uint64)).view(np.int64)])
                value = np.concatenate([n[light], pair[0]])
                # How many n-grams a named row stands for; 0: a row by n-gram.
                named = np.concatenate([np.zeros(ones, dtype=np.int32), times.astype(np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(named), pa.array(value), pa.array(np.concatenate([doc[light], pair[1]]))], names=["key", "named", "value", "doc"])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(grp: np.ndarray, doc: np.ndarray, grams: np.ndarray | None = None) -> pa.RecordBatch:
            pair, back = np.unique(np.stack([grp, doc]), axis=1, return_inverse=True) if len(grp) else (np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
            total = np.bincount(back.reshape(-1), weights=grams, minlength=pair.shape[1]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(total)], names=["grp", "doc", "grams"])

        carry = np.zeros((3, 0), dtype=np.int64)
        settled = None  # the name of the carried segment's group, once rows of it have gone out
        for batch in batches:
            times = batch["named"].to_numpy()
            named = times > 0
            key, value, doc = (batch[c].to_numpy() for c in ("key", "value", "doc"))
            yield out(value[named], doc[named], times[named])
            rows = np.concatenate([carry, np.stack([key, value, doc])[:, ~named]], axis=1)
            # A segment: rows of one n-gram whose sizes allow links, as no size jumps too far from the one before.
            new = np.ones(rows.shape[1], dtype=bool)
            new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] * rule.num > rows[1, :-1] * rule.den)
            begins = np.flatnonzero(new)
            done = begins[-1] if len(begins) else 0
            carry = rows[:, done:]
            yield out(*_settle(rows[:, :done], begins[:-1], settled))
            if len(begins) > 1:
                settled = None
            if carry.shape[1] > HELD_ROWS:
                settled = int(carry[2].min()) if settled is None else settled
                yield out(np.full(carry.shape[1], settled), carry[2])
                carry = carry[:, -1:]
        yield out(*_settle(carry, np.zeros(1 if carry.shape[1] else 0, dtype=np.int64), settled))

    met = docs.mapInArrow(prefixes, "key bigint, named int, value bigint, doc bigint")
    met = met.repartition("key").sortWithinPartitions("key", "value", "doc")
    return met.mapInArrow(groups, "grp bigint, doc bigint, grams bigint").groupBy("grp", "doc").agg(F.sum("grams").alias("grams"))


def _settle(rows: np.ndarray, begins: np.ndarray, first_name: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Group names and members of whole segments; those of one row are none."""
    if not len(begins):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(begins, rows.shape[1]))
    name = np.minimum.reduceat(rows[2], begins)
    keep = count > 1
    if first_name is not None:
        name[0], keep[0] = first_name, True
    return np.repeat(name, count)[np.repeat(keep, count)], rows[2][np.repeat(keep, count)]


class _Node:
    """A run of n-grams that all sets below share."""

    __slots__ = ("grams", "children", "ends", "least", "most", "any", "mixed")

    def __init__(self, grams, size, number):
        self.grams, self.children, self.ends = grams, {}, []
        self.least = self.most = size
        self.any, self.mixed = number, False


class PrefixTree:
    """A compressed trie of n-gram sets, as sorted arrays of ranks in an order
    common to all of them."""

    def __init__(self, rule: Rule, universe: int):
        self.rule, self.root = rule, _Node(np.zeros(0, dtype=np.int64), 1 << 40, -1)
        self.root.most = 0
        self.parent: list[int] = []
        self.mark = np.zeros(universe, dtype=bool)

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def link(self, grams: np.ndarray) -> list[int]:
        """Adds a set, the next number; sets come in order of size.  Returns
        a partner in each component that it links with."""
        me, size = len(self.parent), len(grams)
        self.parent.append(me)
        partners = []
        self.mark[grams] = True
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if node.any >= 0 and not node.mixed and self.find(node.any) == self.find(me):
                continue
            # Sets of the subtree are no larger than this one, and need at least so much in common.
            need = self.rule.needed(size, max(node.least, -(-self.rule.num * size // self.rule.den)))
            if len(node.grams):
                overlap += int(self.mark[node.grams].sum())
                depth += len(node.grams)
                mine = size - int(np.searchsorted(grams, node.grams[-1], "right"))
            else:
                mine = size
            if overlap + min(mine, node.most - depth) < need or node.most * self.rule.den < self.rule.num * size:
                continue
            for other in node.ends:
                if overlap >= self.rule.needed(size, depth) and self.find(other) != self.find(me):
                    partners.append(other)
                    self.parent[self.find(other)] = self.find(me)
                    break
            stack += [(child, overlap, depth) for child in node.children.values()]
        self.mark[grams] = False
        self._insert(grams, me)
        return partners

    def _insert(self, grams: np.ndarray, me: int) -> None:
        node, at, size = self.root, 0, len(grams)
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if node.any < 0:
                node.any = me
            elif not node.mixed and self.find(node.any) != self.find(me):
                node.mixed = True
            if at == size:
                node.ends.append(me)
                return
            child = node.children.get(int(grams[at]))
            if child is None:
                new = _Node(grams[at:], size, me)
                new.ends.append(me)
                node.children[int(grams[at])] = new
                return
            n = min(len(child.grams), size - at)
            differ = np.flatnonzero(child.grams[:n] != grams[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.grams):
                upper = _Node(child.grams[:same], child.least, child.any)
                upper.most, upper.mixed = child.most, child.mixed
                child.grams = child.grams[same:]
                upper.children[int(child.grams[0])] = child
                node.children[int(grams[at])] = upper
                child = upper
            node, at = child, at + same


def _join(docs: np.ndarray, sets: list[np.ndarray], rule: Rule, known: Order | Counters) -> tuple[list[int], list[int], np.ndarray]:
    """What connects each component of a group, each set but the one of the
    smallest document with that one (a star is flat, so few rounds join stars
    of several groups), and the component of each set.  In the trie stands
    first what is last in the global order: the n-grams that most sets share."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), docs[k]))
    grams, back = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(grams), dtype=np.int64)
    rank[np.lexsort((grams, known.frequency(grams)))] = np.arange(len(grams))[::-1]
    ranks = np.split(rank[back], np.cumsum([len(s) for s in sets])[:-1])
    tree = PrefixTree(rule, len(grams))
    for k in order:
        tree.link(np.sort(ranks[k]))
    part = np.empty(len(sets), dtype=np.int64)
    part[order] = [tree.find(k) for k in range(len(order))]
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, part, docs)
    leaf = docs != least[part]
    return docs[leaf].tolist(), least[part][leaf].tolist(), part


def _bloom(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(ids.astype(np.uint64))
    return (h % np.uint64(bits)).astype(np.int64), (mix64(h) % np.uint64(bits)).astype(np.int64)


def _members(met: DataFrame, rule: Rule) -> DataFrame:
    """Without memberships that can give no link.

    Linked sets share ``surplus`` n-grams of their prefixes or more, and each
    of these leads both to a common group.  So a document needs that many in
    groups of several; one with fewer leaves, which leaves others with fewer.
    Of the groups that a document shares with a partner, one has at least its
    need divided by the number of its groups.
    """

    def several(table: DataFrame) -> DataFrame:
        return table.join(table.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1").select("grp"), "grp", "left_semi")

    least = F.ceil(F.col("n") * rule.num / rule.den).cast("bigint")  # the smallest partner's size
    need = F.floor(least * 3 / 100) + 1
    for _ in range(2):
        met = stored(several(met), "met")
        own = met.groupBy("doc").agg(F.sum("grams").alias("all_grams"), F.count("*").alias("all_groups"), F.max("n").alias("n"))
        own = own.where(F.col("all_grams") >= need).select("doc", (need / F.col("all_groups")).alias("need"))
        judged = met.join(own, "doc")
        met = judged.drop("need")
    return several(judged.where(F.col("grams") >= F.col("need")).drop("need"))


def _only(wanted: DataFrame) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """What leaves of a batch the documents in ``wanted`` (and, as a filter of
    bounded size decides, some others).  It runs in the step that reads the
    texts, so a task needs one Python process for both."""
    n = wanted.count()
    bits = 1 << 10
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, dtype=bool)
        for batch in batches:
            for at in _bloom(batch["doc"].to_numpy(), bits):
                table[at] = True
        packed = np.packbits(table).reshape(-1, min(bits // 8, 1 << 16))
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[k].tobytes() for k in some], type=pa.binary())], names=["at", "bits"])

    width = min(bits // 8, 1 << 16)
    table = np.zeros((bits // 8 // width, width), dtype=np.uint8)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, page in zip(batch["at"].to_pylist(), batch["bits"], strict=True):
                page = np.frombuffer(page.as_buffer(), dtype=np.uint8)
                pages[at] = pages[at] | page if at in pages else page.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int32()), pa.array([page.tobytes() for page in pages.values()], pa.binary())], names=["at", "bits"])

    # Pages of all tasks are put together by page: the driver gets each once, in
    # one job (a local iterator starts one for each partition), FILTER_BITS at most.
    pages = wanted.select("doc").mapInArrow(fill, "at int, bits binary").repartition("at").mapInArrow(joined, "at int, bits binary")
    for row in pages.collect():
        table[row["at"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    held = wanted.sparkSession.sparkContext.broadcast(table.reshape(-1))

    def only(batch: pa.RecordBatch) -> pa.RecordBatch:
        def has(at: np.ndarray) -> np.ndarray:
            return (held.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

        one, two = _bloom(batch["doc"].to_numpy(), bits)
        return batch.filter(pa.array(has(one) & has(two)))

    return only


def _sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """doc and grams of the documents in ``wanted`` (and of some others)."""
    only = _only(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(only, batches):
            for first, last, row, gram in _sets(batch["text"], rule.n):
                ends = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(ends), pa.array(gram.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch["doc"].slice(first, last - first), grams], names=["doc", "grams"])

    return docs.mapInArrow(rows, "doc bigint, grams array<bigint>")


def _linked(placed: DataFrame, sets: DataFrame, rule: Rule, order) -> DataFrame:
    """Joins each part (grp, part) of ``placed`` (with doc, pivot and
    watched) by a trie.  Rows: links (a, b), and of the watched parts the
    members outside the pivot's component (grp, part, a)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        now: tuple = ()

        def end() -> Iterator[pa.RecordBatch]:
            # Of rows that share an id, one set counts.
            docs = np.array([d for d, _ in held], dtype=np.int64)
            if len(docs) > 1:
                a, b, part = _join(docs, [g for _, g in held], rule, order.value)
                grp, number, pivot, watched = now
                out = docs[part != part[np.flatnonzero(docs == pivot)[0]]].tolist() if watched and (docs == pivot).any() else docs.tolist() if watched else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([grp] * (len(a) + len(out)), type=pa.int64()), pa.array([number] * (len(a) + len(out)), type=pa.int32()),
                        pa.array(a + out, type=pa.int64()), pa.array(b + [None] * len(out), type=pa.int64()),
                    ],
                    names=["grp", "part", "a", "b"],
                )

        for batch in batches:
            grps, parts, docs, pivots, watched = (batch[c].to_pylist() for c in ("grp", "part", "doc", "pivot", "watched"))
            values, offsets = batch["grams"].flatten().to_numpy().view(np.uint64), batch["grams"].offsets.to_numpy()
            offsets = offsets - offsets[0]
            for k in range(batch.num_rows):
                key = (grps[k], parts[k], pivots[k], watched[k])
                if key != now:
                    yield from end()
                    held, now = [], key
                if not held or held[-1][0] != docs[k]:
                    held.append((docs[k], values[offsets[k] : offsets[k + 1]].copy()))
        yield from end()

    whole = placed.join(sets, "doc").select("grp", "part", "doc", "pivot", "watched", "grams")
    whole = whole.repartition("grp", "part").sortWithinPartitions("grp", "part", "doc", "grams")
    return whole.mapInArrow(rows, "grp bigint, part int, a bigint, b bigint")


def _place(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups of ``members`` that hold several (grp, pivot, parts), and in
    which parts of them each member is; the pivot is in all."""
    groups = members.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("grams"), F.min("doc").alias("pivot")).where("size > 1")
    parts = F.greatest(F.ceil(F.col("size") / PART_SETS), F.ceil(F.col("grams") / PART_GRAMS)).cast("int")
    groups = stored(groups.select("grp", "pivot", parts.alias("parts")), "groups")
    part = F.when(F.col("doc") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")))
    placed = members.join(groups, "grp").select("grp", "doc", "pivot", F.explode(part).alias("part"), (F.col("parts") > 1).alias("watched"))
    return groups, stored(placed, "placed")


def _found(placed: DataFrame, texts: DataFrame, rule: Rule, order, name: str) -> tuple[DataFrame, DataFrame]:
    """The links of ``placed``, and who is outside the pivot's component (grp, doc)."""
    found = stored(_linked(placed, _sets_of(texts, placed.select("doc").distinct(), rule), rule, order), name)
    return found.where("b is not null").select("a", "b"), found.where("b is null").select("grp", F.col("a").alias("doc")).distinct()


def _apart(texts: DataFrame, placed: DataFrame, rest: DataFrame, size: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that join ``rest``, what is outside its pivot's component
    in some part, with the other parts of its groups, and no fewer than
    connect what these join.

    All members of such groups meet anew, by the n-grams that are rare among
    them: rows grow with the n-grams of their prefixes.
    """
    near = placed.join(rest.select("grp").distinct(), "grp", "left_semi").select("doc").distinct()
    near = near.join(rest.select("doc").distinct().withColumn("outside", F.lit(True)), "doc", "left").join(size, "doc")
    near = stored(near, "apart")
    only = _only(near)
    order = texts.sparkSession.sparkContext.broadcast(_counters(texts, rule, only))
    met = stored(_memberships(texts, rule, order, only).join(near, "doc"), "met-apart")
    met = met.join(met.where("outside").select("grp").distinct(), "grp", "left_semi").drop("outside")
    groups, placed = _place(stored(_members(met, rule), "members-apart"))
    links, rest = _found(placed, texts, rule, order, "links-apart")
    if rest.isEmpty():
        return links
    # Every part of a group meets every chunk of what is still outside the pivot's component.
    rest = stored(rest, "outside-again")
    many = rest.groupBy("grp").agg(F.ceil(F.count("*") / PART_SETS).cast("int").alias("chunks"))
    wide = many.join(groups, "grp")
    own = placed.where("watched").join(wide.select("grp", "chunks", "parts"), "grp").select("grp", "doc", "pivot", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "parts")
    probe = rest.join(wide, "grp").withColumn("chunk", F.pmod(F.xxhash64("doc", F.lit(1)), F.col("chunks")).cast("int"))
    probe = probe.select("grp", "doc", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk", "parts")
    again = own.unionByName(probe).select("grp", "doc", "pivot", (F.col("chunk") * F.col("parts") + F.col("part")).cast("int").alias("part"), F.lit(False).alias("watched")).distinct()
    return links.unionByName(_found(stored(again, "placed-again"), texts, rule, order, "links-again")[0])


def components(edges: DataFrame) -> DataFrame:
    """doc and comp, the smallest document it is connected with, of all that
    ``edges`` (a, b) name but these smallest, by alternating large and small
    stars."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # Done when every document hangs on one other, and none hangs on it.
        ends = edges.select(F.col("u").alias("doc"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("doc"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("doc").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("comp"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, "small-star")


def join_groups(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by
    links, itself included) of each id in ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased; a text of
    fewer than n words has them all as one n-gram; one without words, or null,
    has an empty set and no link.  Repeated rows of an id are one document; if
    their texts differ, the one whose set has the smallest digest gives its
    size and copies, and links count for the id.  Rows with a null id are left
    out, other columns play no part, an empty table gives no row.
    """
    texts = _read(docs, id_col, text_col)
    seen = stored(_profile(texts, rule), "set-profile")
    frequent = seen.where("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen"), F.min("doc").alias("doc"))
    frequent = most_frequent(stored(frequent, "frequent"), "seen", FREQUENT)[0].toArrow()
    order = Order(frequent["gram"].to_numpy().view(np.uint64), frequent["seen"].to_numpy(), frequent["doc"].to_numpy())
    every = seen.where("gram is null").groupBy("doc").agg(F.min(F.struct("digest", "n")).alias("s")).select("doc", "s.n", "s.digest")
    every = stored(every, "sets")
    first = stored(every.where("n > 0").groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")), "set-groups")
    rep = stored(every.join(first.drop("copies"), "digest", "left").select("doc", "n", F.coalesce("rep", "doc").alias("rep")), "representatives")

    order = docs.sparkSession.sparkContext.broadcast(order)
    met = _memberships(texts, rule, order)
    # Copies have the same n-grams in the same groups.
    met = stored(met.join(rep, "doc").groupBy("grp", F.col("rep").alias("doc")).agg(F.max("grams").alias("grams"), F.max("n").alias("n")), "met")
    members = stored(_members(met, rule), "members")
    _, placed = _place(members)
    links, rest = _found(placed, texts, rule, order, "links")
    if not rest.isEmpty():
        links = links.unionByName(_apart(texts, placed, stored(rest, "outside"), rep.select("doc", "n"), rule))
    comp = stored(components(links), "components")
    return (
        rep.join(comp.withColumnRenamed("doc", "rep"), "rep", "left")
        .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))
    )


#: Near duplicates on word shingles, where nothing else is said.
NEAR = Rule(5, 80, 100)


def keep_one(docs: DataFrame, rule: Rule = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id;
    columns as they are.  Rows with a null id stay."""
    (own,) = free_names(docs, "gone")
    gone = stored(join_groups(docs, rule, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(own)), "near-copies")
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col(own), "left_anti")
