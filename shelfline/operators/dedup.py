"""Duplicates, unions and differences of product rows.

Rows have no order of their own: ``ordinal`` is their order of arrival and
decides every tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.js import filled
from shelfline.functions.urls import increment_key
from shelfline.functions.validate import feedback_volume


def product_key() -> Column:
    """By id, else by canonical URL, else a key of the row's own."""
    return F.coalesce(
        F.concat(F.lit("asin:"), F.nullif(F.col("asin"), F.lit(""))),
        F.concat(F.lit("url:"), F.nullif(F.col("canonical_url"), F.lit(""))),
        F.concat(F.lit("fallback:"), F.col("ordinal").cast("string")),
    )


def completeness() -> Column:
    """0 to 8: title 1, price 2, rating 1, feedback 3, image 1."""
    point = lambda condition, n: F.when(condition, n).otherwise(0)
    positive = lambda c: (F.col(c) > 0) & ~F.isnan(c)
    return (
        point(filled(F.col("title")), 1) + point(positive("price"), 2) + point(positive("rating"), 1)
        + point(feedback_volume(F.col("review_count"), F.col("rating_count")).isNotNull(), 3) + point(filled(F.col("image_url")), 1)
    )


def merit() -> Column:
    """What makes the better of two rows of a key: organic, complete, first."""
    return F.struct((~F.coalesce(F.col("is_sponsored"), F.lit(False))).alias("organic"), completeness().alias("points"), (-F.col("ordinal")).alias("order"))


def deduplicate(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One whole row a key (and ``within``): an organic one before a sponsored,
    then the more complete, then the first.  It takes the ordinal of the
    key's first row.

    A keyed reduce, so copies are combined before the shuffle and no key
    needs its rows together.
    """
    rest = [c for c in df.columns if c != "ordinal" and c not in within]
    best = F.max_by(F.struct(*rest), merit()).alias("best")
    grouped = df.groupBy(*within, product_key().alias("__key")).agg(F.min("ordinal").alias("ordinal"), best)
    parts = {"ordinal": F.col("ordinal")} | {c: F.col(c) for c in within} | {c: F.col(f"best.{c}") for c in rest}
    return grouped.select(*[parts[c].alias(c) for c in df.columns])


def with_increment_key(df: DataFrame, name: str = "key") -> DataFrame:
    pid, source = F.coalesce(F.nullif(F.col("product_id"), F.lit("")), F.col("asin")), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.col("marketplace"))
    return df.withColumn(name, increment_key(pid, source, F.col("canonical_url"), F.col("url"), F.col("title")))


def new_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` that no row of ``before`` is the same product as,
    the first of each product."""
    fresh = with_increment_key(after, "__key").join(with_increment_key(before, "__key").select("__key").distinct(), "__key", "left_anti")
    first = fresh.groupBy("__key").agg(F.min_by(F.struct(*after.columns), "ordinal").alias("row"))
    return first.select("row.*")


def append(all_rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The bag union, later rows after earlier ones."""
    top = all_rows.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("__top"))
    moved = fresh.crossJoin(F.broadcast(top)).withColumn("ordinal", F.col("ordinal") + F.col("__top")).drop("__top")  # one row
    return all_rows.unionByName(moved, allowMissingColumns=True)


def unvisited(pages: DataFrame, visited: DataFrame, key: str = "canonical") -> DataFrame:
    """Pages whose identity has not been visited."""
    return pages.join(visited.select(key).distinct(), key, "left_anti")
