"""Row filters of the ranking: validity, relevance, budget, organic rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.js import WHITE_IN, leading_number
from shelfline.functions.text import Query, with_relevance
from shelfline.functions.validate import is_eligible, normal_form


def validate(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Eligible products in normal form, with the columns ``keep`` as they are."""
    fields = ("title", "product_id", "asin", "source", "marketplace", "canonical_url", "url")
    return raw.where(is_eligible(*[F.col(c) for c in fields])).select(*keep, *[c.alias(n) for n, c in normal_form().items()])


def relevant(df: DataFrame, query: str | None) -> DataFrame:
    """Without rows of low relevance; all rows where the query says nothing."""
    if not Query.of(query).usable:
        return df
    return with_relevance(df, query, name="__relevance").where(F.col("__relevance.category") != "LOW").drop("__relevance")


def relevance_counts(df: DataFrame, query: str | None) -> DataFrame:
    """One row: total, relevant, removed and whether the query could be used."""
    q = Query.of(query)
    low = F.count_if(F.col("r.category") == "LOW") if q.usable else F.lit(0).cast("bigint")
    counted = with_relevance(df, query, name="r").agg(F.count("*").alias("total"), low.alias("removed"))
    return counted.select("total", (F.col("total") - F.col("removed")).alias("relevant"), "removed", F.lit(q.usable).alias("available"), F.lit(q.text if q.usable else "").alias("query_used"))


def in_budget(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Prices in the range; with a bound, rows without a price or free go."""
    if low is None and high is None:
        return df
    keep = F.col("price").isNotNull() & (F.col("price") != 0)
    if low is not None:
        keep = keep & ((F.col("price") >= low) | F.isnan("price"))
    if high is not None:
        keep = keep & ((F.col("price") <= high) | F.isnan("price"))
    return df.where(keep)


def organic(df: DataFrame, flag: str = "sponsored") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def budget(low: Column, high: Column) -> Column:
    """What two inputs say: struct (min, max, error)."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), rf"[₹,{WHITE_IN}]", "")
    a, b = clean(low), clean(high)
    x, y = leading_number(a), leading_number(b)
    bad = lambda text, number: (text != "") & F.coalesce(number < 0, F.lit(True))
    error = (
        F.when(bad(a, x), "Please enter a valid minimum price.")
        .when(bad(b, y), "Please enter a valid maximum price.")
        .when(x > y, "Minimum price cannot be greater than maximum price.")
    )
    return F.struct(F.when(error.isNull(), x).alias("min"), F.when(error.isNull(), y).alias("max"), error.alias("error"))
