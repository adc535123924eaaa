"""Price statistics of a ranked set, and each price's place in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.js import finite, round_half_up
from shelfline.functions.validate import is_price


def price_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """count, valid_count, lowest, highest, average (rounded) and has_prices,
    over usable prices, of the whole table or by group.  Sums are of
    hundredths, so they do not depend on the order of the rows."""
    usable = F.when(is_price(F.col("price")), F.col("price"))
    exact = F.sum(usable.cast("decimal(28,6)")) / F.count(usable)
    return df.groupBy(*by).agg(
        F.count("*").alias("count"), F.count(usable).alias("valid_count"), F.min(usable).alias("lowest"), F.max(usable).alias("highest"),
        F.floor(exact.cast("double") + F.lit(0.5)).cast("double").alias("average"), (F.count(usable) > 0).alias("has_prices"),
    )


def lowest_priced(df: DataFrame) -> DataFrame:
    """The cheapest row: of equals the one with more reviews, then the first."""
    reviews = F.when(finite(F.col("review_count")), F.col("review_count").cast("double")).otherwise(-1.0)
    best = df.where(is_price(F.col("price"))).agg(F.min_by(F.struct(*df.columns), F.struct("price", -reviews, "ordinal")).alias("row"))
    return best.where("row is not null").select("row.*")


def with_position(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with a struct (type, diff): lowest, or below or above the
    average; null where it is the average or no price."""
    diff = round_half_up(F.col("average") - F.col("price"))
    kind = F.when(F.col("price") == F.col("lowest"), "lowest").when(diff > 0, "below").when(diff < 0, "above")
    gap = F.when(F.col("price") == F.col("lowest"), F.lit(0)).when(diff != 0, F.abs(diff))
    usable = is_price(F.col("price")) & F.col("has_prices")
    both = df.crossJoin(F.broadcast(stats.select("lowest", "average", "has_prices")))  # one row
    place = F.struct(F.when(usable, kind).alias("type"), F.when(usable, gap).cast("bigint").alias("diff"))
    return both.withColumn("position", place).drop("lowest", "average", "has_prices")


def budget_utilization(price: Column, budget: Column) -> Column:
    """Percent of the budget with one decimal, or null."""
    share = price / F.nullif(budget, F.lit(0.0)) * 100
    return F.when(is_price(price) & finite(budget) & (budget > 0) & finite(share), round_half_up(share * 10) / 10)


def utilization_text(price: Column, budget: Column) -> Column:
    share = budget_utilization(price, budget)
    number = F.when(share == F.floor(share), F.floor(share).cast("string")).otherwise(F.round(share, 1).cast("string"))
    return F.concat(number, F.lit("%"))
