"""The raw product row, the union of what all shops yield."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_PRODUCT = (
    "ordinal bigint, title string, price double, rating double, rating_count double, review_count double, image string, image_url string, "
    "url string, canonical_url string, product_id string, asin string, sponsored boolean, is_sponsored boolean, source string, marketplace string"
)


def raw_products(df: DataFrame) -> DataFrame:
    """``df`` with every raw column, in order; missing ones are null."""
    columns = [c.strip().split(" ") for c in RAW_PRODUCT.split(",")]
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in columns])
