"""How sources diverge in their words, by a systolic rotation.

The words that a language keeps are cut into blocks, and the groups (language
and source) of a language into stations of a few.  A station's groups stay in
their partition, one dense vector a group and block; the groups of the other
stations pass by as compressed sparse vectors, in the rounds of a round-robin
tournament: in round r station i meets station (r - i) modulo their number, so
every two meet once, and every station meets itself once.  A meeting gives the
divergence in both directions.  The language's own vector passes by as well,
and a heap a group keeps the terms that stand out most.

A task holds the vectors of one station in one block, one vector that passes,
and its heaps, whatever the number of groups, terms and documents.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfline.llm.common import stored

#: A language keeps terms of so many documents at least.
LEAST_DOCS = 30
#: Ranks of terms.
RANKS = 50
#: Shares are in units of 1 / UNIT, every count raised by PRIOR.
UNIT, PRIOR = 10**9, 5
#: Terms of a block, about; blocks of a task; groups of a station.
BLOCK, CHUNK, STATION = 4096, 16, 8
#: Counts that a task holds before it passes them on, and bytes of text
#: counted at once (one longer term is still whole).
HELD, SLICE = 200_000, 4_000_000

#: Bytes that are not ASCII belong to characters that are not, so this finds
#: the characters outside [\x00-\x40\x5B-\x60\x7B-\x7F] of lower-cased text.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_OTHER = re.compile(rb"[^a-z\x80-\xff]")


def _terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, A-Z lower-cased, in lists of some MB."""
    data, at = text.encode().lower(), 0
    while at < len(data):
        cut = _OTHER.search(data, at + SLICE)
        end = cut.end() if cut else len(data)
        yield _TERM.findall(data, at, end)
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n and docs, added up within the task as far as it
    holds them; the empty term marks a group that occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in held.items() for term, n in [*counts.items(), (b"", 0)]]
        held.clear()
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    new = 0
    for batch in batches:
        for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts, docs = held[lang, source]
            own: Counter = Counter()
            for found in _terms(text):
                own.update(found)
            for term, n in own.items():
                counts[term] += n
            docs.update(own.keys())
            new += len(own)
            if new > HELD:
                new = sum(len(c) for c, _ in held.values())
                if new > HELD:
                    yield out()
                    new = 0
    yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it) of the
    whole texts; each group that occurs has a row of the empty term too.
    Null text, lang and source count as empty."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * n / total), exactly (0 <= n <= total)."""
    if total >= 1 << 53:
        return np.array([1 + UNIT * int(x) // total for x in n], dtype=np.int64)
    whole = n // total
    rest = n % total
    for _ in range(3):  # a long division by digits of base 1000
        rest = rest * 1000
        whole = whole * 1000 + rest // total
        rest = rest % total
    return whole + 1


def _pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """A sparse vector: gaps between the places, then the counts."""
    return zlib.compress(np.diff(at, prepend=0).astype("<i4").tobytes() + n.astype("<i8").tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(packed)
    n = len(data) // 12
    return np.cumsum(np.frombuffer(data, "<i4", n)), np.frombuffer(data, "<i8", n, 4 * n)


def _sparse(key, table):
    at, n = table["at"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(at)
    return pa.table({"lang": [key[0].as_py()], "source": [key[1].as_py()], "block": pa.array([key[2].as_py()], pa.int32()), "packed": [_pack(at[order], n[order])], "total": pa.array([int(n.sum())], pa.int64())})


def _whole(key, table):
    """A language's own vector of a block, with the terms in their order."""
    at = table["at"].to_numpy()
    order = np.argsort(at)
    terms = table["term"].take(pa.array(order)).to_pylist()
    n = table["n"].to_numpy()[order]
    return pa.table({
        "lang": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "packed": [_pack(at[order], n)], "total": pa.array([int(n.sum())], pa.int64()),
        "terms": [zlib.compress("\0".join(terms).encode(), 1)], "wide": pa.array([len(at)], pa.int32()),
    })


#: What a station reads, in this order: its groups (kind 0), the language's own
#: vector (1), then those that pass by (2).
AT_STATION = ["lang", "station", "chunk", "block", "kind", "round", "place", "source", "wide", "kept", "total", "packed", "terms"]


def _hosted(i: Column, stations: Column) -> Column:
    """(host, round) of all stations that station ``i`` travels to: of two
    that meet, the lower is the host where they are an odd number apart."""
    others = F.filter(F.sequence(F.lit(0), stations - 1), lambda j: F.when(j < i, (i - j) % 2 == 1).otherwise((j > i) & ((j - i) % 2 == 0)))
    return F.transform(others, lambda j: F.struct(j.cast("int").alias("station"), ((i + j) % stations).cast("int").alias("round"), F.lit(2).alias("kind")))


def _meet(ranks: int):
    """What a task of stations does with the rows that reach it."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = None, None
        resident: list[tuple[str, np.ndarray, np.ndarray]] = []
        sums: dict[tuple[str, str], int] = defaultdict(int)
        heaps: dict[str, list] = {}

        def out(lang: str) -> pa.RecordBatch:
            rows = [("pair", a, b, v) for (a, b), v in sums.items()] + [("term", a, term.decode(), -v) for a, heap in heaps.items() for v, term in heap]
            sums.clear()
            heaps.clear()
            columns = [pa.array([lang] * len(rows), pa.string()), *[pa.array([r[k] for r in rows], pa.int64() if k == 3 else pa.string()) for k in range(4)]]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "part", "a", "b", "value"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if task != (r["lang"], r["station"], r["chunk"]):
                    if task:
                        yield out(task[0])
                    task, block = (r["lang"], r["station"], r["chunk"]), None
                if block != r["block"]:
                    block, resident = r["block"], []
                whole = max(1, r["total"] + PRIOR * r["kept"])
                p, n = np.zeros(r["wide"], dtype=np.int64), np.zeros(r["wide"], dtype=np.int64)
                if r["packed"] is not None:
                    at, counts = _unpack(r["packed"])
                    n[at] = counts
                if r["wide"]:
                    p = shares(n + PRIOR, whole)
                if r["kind"] == 1:
                    terms = zlib.decompress(r["terms"]).split(b"\0") if r["terms"] is not None else []
                    for source, mine, counted in resident:
                        over = np.flatnonzero((counted > 0) & (mine > p))
                        found = [(-int(mine[k] - p[k]), terms[k]) for k in over]
                        heaps[source] = heapq.nsmallest(ranks, heaps.get(source, []) + found)
                    continue
                for source, other, _ in resident:
                    sums[source, r["source"]] += int(np.abs(p - other).sum())
                if r["kind"] == 0:
                    resident.append((r["source"], p, n))
        if task:
            yield out(task[0])

    return meet


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: of every group the other
    sources of its language by divergence (part ``pair``, all ranks), and the
    terms it has more of than its language (part ``term``, ``ranks`` at most).

    A term's share is 1 + floor(10^9 * (n + 5) / (N + 5 V)), N being the
    group's count of all kept terms and V their number; a divergence is the sum
    of absolute differences over all kept terms, 0 where there is none.  Ties
    go to the smaller item by bytes.  Null text, lang and source count as
    empty; repeated rows count each; documents without a term make a group all
    the same; an empty table gives no row; other columns play no part.
    """
    counts = stored(term_counts(docs), "term-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least_docs)
    kept = stored(kept.drop("docs"), "kept-terms")
    blocks = max(1, -(-kept.count() // BLOCK))
    in_block = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    # A block has about BLOCK terms, whatever the input.
    placed = stored(in_block.withColumn("at", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1), "placed-terms")
    own = placed.select("lang", "block", "at", "term", F.col("all").alias("n"))
    wholes = stored(own.groupBy("lang", "block").applyInArrow(_whole, "lang string, block int, packed binary, total bigint, terms binary, wide int"), "language-vectors")
    of_groups = counts.join(placed.select("lang", "term", "block", "at"), ["lang", "term"]).select("lang", "source", "block", "at", "n")
    packed = stored(of_groups.groupBy("lang", "source", "block").applyInArrow(_sparse, "lang string, source string, block int, packed binary, total bigint"), "group-vectors")

    # The groups in their stations, one row a group.
    by_lang = Window.partitionBy("lang")
    groups = counts.where("term = ''").select("lang", "source").join(packed.groupBy("lang", "source").agg(F.sum("total").alias("total")), ["lang", "source"], "left")
    place = F.row_number().over(by_lang.orderBy("source")) - 1
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), place.alias("place"), F.ceil(F.count("*").over(by_lang) / STATION).cast("int").alias("stations"))
    groups = stored(groups.withColumn("station", (F.col("place") % F.col("stations")).cast("int")), "stations")
    # The languages, and their blocks; one without terms has an empty one.
    langs = groups.groupBy("lang").agg(F.max("stations").alias("stations"))
    sizes = wholes.groupBy("lang").agg(F.sum("total").alias("all"), F.sum("wide").alias("kept"))
    of_lang = langs.join(sizes, "lang", "left").join(wholes.drop("total"), "lang", "left")
    of_lang = stored(of_lang.select(
        "lang", "stations", F.coalesce("all", F.lit(0)).alias("all"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("wide", F.lit(0)).alias("wide"), "packed", "terms",
    ), "language-blocks")

    cells = groups.drop("stations").join(of_lang.select("lang", "stations", "kept", "block", "wide"), "lang").join(packed.drop("total"), ["lang", "source", "block"], "left")
    at_home = F.array(F.struct(F.col("station").alias("station"), F.lit(0).alias("round"), F.lit(0).alias("kind")))
    cells = cells.withColumn("to", F.explode(F.concat(at_home, _hosted(F.col("station"), F.col("stations")))))
    columns = {"chunk": F.floor(F.col("block") / CHUNK).cast("int"), "station": F.col("to.station"), "round": F.col("to.round"), "kind": F.col("to.kind"), "terms": F.lit(None).cast("binary")}
    cells = cells.withColumns(columns).select(*AT_STATION)
    wide = of_lang.withColumn("station", F.explode(F.sequence(F.lit(0), F.col("stations") - 1)))
    none = {"chunk": columns["chunk"], "kind": F.lit(1), "round": F.lit(0), "place": F.lit(-1), "source": F.lit(None).cast("string"), "total": F.col("all")}
    moving = cells.unionByName(wide.withColumns(none).select(*AT_STATION))
    moving = moving.repartition("lang", "station", "chunk").sortWithinPartitions("lang", "station", "chunk", "block", "kind", "round", "place")
    met = stored(moving.mapInArrow(_meet(ranks), "lang string, part string, a string, b string, value bigint"), "divergences")

    pairs = met.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    terms = met.where("part = 'term'").select("lang", F.col("a").alias("source"), "part", F.col("b").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= ranks))
