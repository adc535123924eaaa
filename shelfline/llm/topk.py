"""Exact top-k search by distributed histogram selection.

Vectors lie in blocks of rows, in the narrowest integers that hold them.  A
cell is a group of candidate blocks and a group of query blocks; the cells
cover the stated query set against all rows.  A task holds a cell's candidates
and lets its query blocks pass by, one matrix product at a time, so that what
is shipped is a block once a cell, not once a pair.  Rather than sort scores,
each round adds up global histograms of every query's scores and narrows the
range that holds the k-th value, until the range is one value; the last pass
keeps what is above it, and ties at it by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfline.llm.common import stored

#: Rows of a block of candidates, and of queries; a task holds a few matrices of their scores.
BLOCK = 1024
#: Blocks of candidates in a cell, and of queries, at most.
CELL = 64
#: Ranges that a round divides the live range of a query into, as a power of two.
BITS = 10
BINS = 1 << BITS
#: The most tasks of a round.
TASKS = 100_000


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id and v (array<bigint>): floor(scale * x) of each component x as
    double, the nearest 64-bit integer where it is beyond these.  Rows whose
    vector is null, or holds a null or a number that is not finite, go."""
    # NaN exceeds every number, so one comparison rejects it and both infinities.
    fine = F.forall(F.col(vec_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & fine).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )


BLOCKS = "block int, dim int, ids binary, wide int, vals binary"


def _blocks(vectors: DataFrame, n: int) -> DataFrame:
    """Rows dealt to ``n`` blocks by a hash of their id, within vectors of one
    length: ids (little-endian int64), and values of ``wide`` bytes each."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(BLOCKS)

    def pack(key, table):
        v = table["v"].combine_chunks()
        ids, flat = table["vec_id"].to_numpy(), v.flatten().to_numpy()
        low, high = int(flat.min(initial=0)), int(flat.max(initial=0))
        wide = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
        row = {"block": key[0].as_py(), "dim": key[1].as_py(), "ids": ids.astype("<i8").tobytes(), "wide": wide, "vals": flat.astype(f"<i{wide}").tobytes()}
        return pa.Table.from_pylist([row], schema=to_arrow_schema(schema))

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("dim", F.size("v"))
    return dealt.groupBy("block", "dim").applyInArrow(pack, schema)


#: The score of a query's own row, below all others; no score is below LEAST or above -LEAST.
OWN = np.iinfo(np.int64).min
LEAST = -(2**63) + 1


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can leave its
    integers, else as integers.  Where 64 bits might not hold a sum it is
    worked out in Python's integers; one beyond them is the nearest of them."""
    top = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if top < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    scores = q.astype(np.int64) @ c.astype(np.int64).T
    if top >= 2**62:
        size = lambda x: np.abs(x.astype(np.float64)).max(axis=1, initial=0)
        for i, j in zip(*np.nonzero(np.outer(size(q), size(c)) * q.shape[1] >= 2**62), strict=True):
            exact = sum(a * b for a, b in zip(q[i].tolist(), c[j].tolist(), strict=True))
            scores[i, j] = min(max(exact, LEAST), -LEAST)
    return scores


@dataclass(frozen=True)
class Blocks:
    """Stored blocks of queries and candidates, and how they meet in cells."""

    queries: DataFrame
    candidates: DataFrame
    owners: DataFrame  # dim, block and query_id
    n_q: int
    n_c: int

    def cells(self, ranges: DataFrame) -> DataFrame:
        """All blocks of each cell (dim, cg, qg): its candidates, then its
        queries with their ranges (query_id, low, need)."""
        tasks = int(self.queries.sparkSession.sparkContext.defaultParallelism)
        # Small tables make smaller cells, so that all tasks have some.
        per_q = min(CELL, self.n_q)
        per_c = max(1, min(CELL, self.n_c * -(-self.n_q // per_q) // tasks))
        qgs, cgs = -(-self.n_q // per_q), -(-self.n_c // per_c)
        held = self.owners.join(ranges, "query_id").groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("query_id", "low", "need"))).alias("ranges"))
        group = lambda n: F.floor(F.col("block") / n).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        of_c = self.candidates.select("dim", group(per_c).alias("cg"), every(qgs).alias("qg"), F.lit(0).alias("kind"), "block", "ids", "wide", "vals", F.lit(None).alias("ranges"))
        of_q = self.queries.join(held, ["dim", "block"]).select("dim", every(cgs).alias("cg"), group(per_q).alias("qg"), F.lit(1).alias("kind"), "block", "ids", "wide", "vals", "ranges")
        of_c = of_c.withColumn("ranges", F.col("ranges").cast(of_q.schema["ranges"].dataType))
        return of_c.unionByName(of_q).repartition(min(qgs * cgs, TASKS), "dim", "cg", "qg").sortWithinPartitions("dim", "cg", "qg", "kind", "block")


def top_k(df: DataFrame, k: int, is_query, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` other rows of the
    highest inner product with each query (all, if fewer), ties to the smaller
    vec_id.

    Scores are exact within 64 bits; one beyond them counts as the nearest
    integer of -(2**63 - 1) to 2**63 - 1, and ties there go by id too.

    ``is_query`` is a condition on the id column.  Repeated ids count once
    (their smallest vector by value); vectors of another length than the
    query's are no candidates of it.  An empty table, or one without queries,
    gives no row.  Other columns play no part.
    """
    vectors = integer_vectors(df, id_col, vec_col, scale)
    vectors = stored(vectors.groupBy("vec_id").agg(F.min("v").alias("v")), "int-vectors")
    chosen = vectors.where(is_query(F.col("vec_id")))
    n_all, n_query = vectors.count(), chosen.count()
    n_q, n_c = -(-max(n_query, 1) // BLOCK), -(-max(n_all, 1) // BLOCK)
    queries = stored(_blocks(chosen, n_q), "query-blocks")
    owners = stored(queries.select("dim", "block", "ids").mapInArrow(_ids_of, "dim int, block int, query_id bigint"), "query-owners")
    blocks = Blocks(queries, stored(_blocks(vectors, n_c), "candidate-blocks"), owners, n_q, n_c)
    # A score's size is at most the product of the norms; the range starts there, a power of BINS wide.
    norm = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] or 0.0
    rounds = 1
    while BINS**rounds < min(2 * norm + 2, 2**64):
        rounds += 1
    low = max(-(BINS**rounds) // 2, LEAST)
    ranges = chosen.select(F.col("vec_id").alias("query_id"), F.lit(low).cast("bigint").alias("low"), F.lit(k).cast("bigint").alias("need"))
    for left in range(rounds - 1, -1, -1):
        ranges = stored(_narrow(blocks, ranges, BITS * left), "score-ranges")
    return _select(blocks, ranges, k)


def _ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], dtype="<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), row["dim"], np.int32)), pa.array(np.full(len(ids), row["block"], np.int32)), pa.array(ids)], names=["dim", "block", "query_id"]
            )


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Query ids, range starts and needs of each query block, and its scores
    with each of the cell's candidate blocks."""
    cell, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if (row["dim"], row["cg"], row["qg"]) != cell:
                cell, held = (row["dim"], row["cg"], row["qg"]), []
            ids = np.frombuffer(row["ids"], dtype="<i8")
            values = np.frombuffer(row["vals"], dtype=f"<i{row['wide']}").reshape(len(ids), row["dim"])
            order = np.argsort(ids)
            ids, values = ids[order], values[order]
            if row["kind"] == 0:
                held.append((ids, values))
                continue
            asked, low, need = np.array([(r["query_id"], r["low"], r["need"]) for r in row["ranges"]], dtype=np.int64).T
            values = values[np.searchsorted(ids, asked)]

            def met(ids=asked, values=values, held=held):
                for cids, c in held:
                    scores = _scores(values, c)
                    at = np.minimum(np.searchsorted(ids, cids), len(ids) - 1)
                    own = np.flatnonzero(ids[at] == cids)
                    scores[at[own], own] = OWN
                    yield cids, scores

            if held:
                yield asked, low, need, met()


def _narrow(blocks: Blocks, ranges: DataFrame, shift: int) -> DataFrame:
    """One round: histograms of BINS bins of ``2 ** shift`` over each live
    range; the bin that holds the k-th score is the next range.  A query with
    fewer than k scores ends at its lowest bin and keeps them all.

    A cell passes on a query's bins from the top as far as they hold the
    scores needed; what is below cannot hold the k-th of all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, low, need, met in _scored(batches):
            table = np.zeros((len(ids), BINS), dtype=np.int64)
            first = np.arange(len(ids))[:, None] * BINS
            for _, scores in met:
                # Scores above the range were counted in an earlier round.  How far above its start, in unsigned integers: up to 2 ** 64.
                bins = (scores.view(np.uint64) - low.view(np.uint64)[:, None]) >> np.uint64(shift)
                live = (scores >= low[:, None]) & (scores != OWN) & (bins < BINS)
                table += np.bincount(bins[live].astype(np.int64) + np.broadcast_to(first, bins.shape)[live], minlength=table.size).reshape(table.shape)
            above = np.cumsum(table[:, ::-1], axis=1)[:, ::-1] - table
            q, b = np.nonzero((table > 0) & (above < need[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(b.astype(np.int32)), pa.array(table[q, b])], names=["query_id", "bin", "n"])

    hist = blocks.cells(ranges).mapInArrow(count, "query_id bigint, bin int, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    seen = ranges.join(hist, "query_id").withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    all_n = Window.partitionBy("query_id")
    hit = seen.withColumn("total", F.sum("n").over(all_n)).withColumn("lowest", F.min("bin").over(all_n)).where(
        ((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))) | ((F.col("total") < F.col("need")) & (F.col("bin") == F.col("lowest")))
    )
    whole = "decimal(38,0)"  # a range's start fits 64 bits, its distance from the first need not
    low = F.col("low").cast(whole) + F.col("bin").cast("decimal(10,0)") * F.lit(1 << shift).cast("decimal(20,0)")
    return hit.select("query_id", low.cast("bigint").alias("low"), (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"))


def _select(blocks: Blocks, ranges: DataFrame, k: int) -> DataFrame:
    """What is above the k-th score, and the smallest ids at it; of a pair of
    blocks at most ``need`` ties a query go on, which is exact as more of one
    block can never be among them."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, low, need, met in _scored(batches):
            for cids, scores in met:
                ties = scores == low[:, None]
                ties &= np.cumsum(ties, axis=1) <= need[:, None]
                q, c = np.nonzero((scores > low[:, None]) | ties)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(cids[c]), pa.array(scores[q, c])], names=["query_id", "vec_id", "score"])

    found = blocks.cells(ranges).mapInArrow(keep, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
