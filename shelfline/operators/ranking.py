"""Rank by feedback volume, and display pages.

The order is total: volume first (none counts as -1), then arrival.  A page
near the top needs a top-k only.  The rank of every row of a large table, or
of every group's rows, is worked out in ranges: rows are sorted in ranges of
the order, counted by range (and group), and a range's ranks follow those
before it, so no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfline.functions.lexicon import PAGE_SIZE
from shelfline.functions.validate import feedback_volume
from shelfline.plans.storage import stored


def volume() -> Column:
    return feedback_volume(F.col("review_count"), F.col("rating_count"))


def by_volume() -> list[Column]:
    return [F.coalesce(F.col("feedback_volume"), F.lit(-1)).desc(), F.col("ordinal").asc()]


def with_rank(df: DataFrame, partition_by: Sequence[str] = (), size: int = PAGE_SIZE) -> DataFrame:
    """``df`` with feedback_volume, rank (from 1, no gaps) and page, over the
    whole table or within ``partition_by``.

    Two tables are written while the plan is built: the rows, and of each row
    its number and what it is ranked by, sorted, whose places count.  The ranks
    are joined to the rows by these numbers.
    """
    rows = stored(df.withColumns({"feedback_volume": volume(), "__row": F.monotonically_increasing_id()}), "to-rank")
    ranks = _ranks(rows.select("__row", *partition_by, "feedback_volume", "ordinal"), partition_by)
    return rows.join(ranks, "__row").withColumn("page", page_of(F.col("rank"), size)).drop("__row")


def _ranks(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """__row and rank."""
    ranges = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    order = [F.col(c).asc() for c in partition_by] + by_volume()
    ordered = df.repartitionByRange(int(ranges), *order).sortWithinPartitions(*order)
    # 33 bits of place within the range, the range's number above them.
    placed = stored(ordered.withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("__place", 33)
    if partition_by:
        return _within(placed.withColumn("__part", part), partition_by)
    counts = placed.groupBy(part.alias("__part")).count()
    before = counts.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # As many rows as there are ranges: the number of shuffle partitions.
    ranked = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return ranked.select("__row", (F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1).alias("rank"))


def _within(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranks within groups: a group's rows of one range are neighbours, after
    those of the ranges before it.  As many rows are joined as there are
    groups and ranges together, so Spark decides how by their size."""
    counts = placed.groupBy("__part", *by).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    names = {c: f"__of_{k}" for k, c in enumerate(by)}
    before = before.select(F.col("__part").alias("__in"), *[F.col(c).alias(n) for c, n in names.items()], "__first", "__before")
    same = F.col("__part") == F.col("__in")
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return placed.join(before, same).select("__row", (F.col("__place") - F.col("__first") + F.col("__before") + 1).alias("rank"))


def top(df: DataFrame, n: int, size: int = PAGE_SIZE) -> DataFrame:
    """The first ``n`` rows with their ranks: a top-k, then one small window."""
    first = df.withColumn("feedback_volume", volume()).orderBy(*by_volume()).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*by_volume())).cast("bigint")).withColumn("page", page_of(F.col("rank"), size))


def page_of(rank: Column, size: int = PAGE_SIZE) -> Column:
    return F.ceil(rank / F.lit(size)).cast("bigint")


def page(df: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """The rows of a display page, from 1; none before it or beyond the last."""
    size = size if size > 0 else PAGE_SIZE
    return top(df, max(number, 0) * size, size).where(F.col("page") == number)


def page_count(n: Column, size: Column) -> Column:
    size = F.when(size > 0, size).otherwise(PAGE_SIZE)
    return F.ceil(n / size).cast("bigint")


def page_range(number: Column, n: Column, size: Column) -> Column:
    """struct (start, end, total) of a display page; zeros outside."""
    step = F.when(size > 0, size).otherwise(PAGE_SIZE)
    ok = (number >= 1) & (number <= page_count(n, size))
    start = (number - 1) * step + 1
    zero = F.lit(0).cast("bigint")
    return F.struct(
        F.when(ok, start.cast("bigint")).otherwise(zero).alias("start"), F.when(ok, F.least(start + step - 1, n).cast("bigint")).otherwise(zero).alias("end"), n.cast("bigint").alias("total")
    )


def rank_class(rank: Column) -> Column:
    return F.when(rank <= 3, F.concat(F.lit("rank-"), rank.cast("string"))).otherwise("rank-default")
