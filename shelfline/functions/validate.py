"""Which fields of a product can be trusted, and its normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfline.functions.js import either, filled, finite, squeeze, trim
from shelfline.functions.lexicon import PLACEHOLDER_TITLES
from shelfline.functions.urls import is_product_url


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_title(c: Column) -> Column:
    t = squeeze(c)
    return _true((F.length(t) >= 3) & ~F.lower(t).isin(PLACEHOLDER_TITLES))


def strict_id(c: Column) -> Column:
    """A ten-character id in upper case, or null."""
    t = F.upper(trim(c))
    return F.when(t.rlike(r"\A[A-Z0-9]{10}\z"), t)


def loose_id(c: Column) -> Column:
    """A ten-character id in upper case; any other trimmed; null if empty."""
    return F.coalesce(strict_id(c), F.nullif(trim(c), F.lit("")))


def is_price(c: Column) -> Column:
    return finite(c) & _true(c >= 0)


def is_rating(c: Column) -> Column:
    return finite(c) & _true(c.between(0, 5))


def is_count(c: Column) -> Column:
    """Whole and not negative."""
    return finite(c) & _true((c >= 0) & (c == F.floor(c)))


def is_image(c: Column) -> Column:
    t = F.lower(trim(c))
    return _true((t != "") & ~t.startswith("data:") & ~t.startswith("javascript:"))


def is_eligible(title: Column, product_id: Column, asin: Column, source: Column, marketplace: Column, canonical_url: Column, url: Column) -> Column:
    """A title, and an id or a product URL: ids of the first shop (or of no
    named one) are strict, others need two characters."""
    pid, shop = either(product_id, asin), either(source, marketplace)
    own = _true(shop.isNull() | (shop == "Amazon"))
    has_id = F.when(own, strict_id(pid).isNotNull() | strict_id(asin).isNotNull()).otherwise(_true(F.length(trim(pid)) >= 2))
    return is_title(title) & (has_id | is_product_url(canonical_url) | is_product_url(url))


def feedback_volume(review_count: Column, rating_count: Column) -> Column:
    """Reviews if there are any, else ratings if any, else null."""
    some = lambda c: F.when(is_count(c) & (c > 0), c)
    return F.coalesce(some(review_count), some(rating_count)).cast("bigint")


def normal_form() -> dict[str, Column]:
    """The columns of a valid product out of the raw ones."""
    pid, image = either(F.col("product_id"), F.col("asin")), either(F.col("image"), F.col("image_url"))
    source = F.coalesce(either(F.col("source"), F.col("marketplace")), F.lit("Amazon"))
    url = F.when(is_product_url(F.col("url")), F.col("url")).when(is_product_url(F.col("canonical_url")), F.col("canonical_url"))
    count = lambda c: F.when(is_count(F.col(c)), F.col(c)).cast("bigint")
    return {
        "ordinal": F.col("ordinal"),
        "title": squeeze(F.col("title")),
        "price": F.when(is_price(F.col("price")), F.col("price")),
        "rating": F.when(is_rating(F.col("rating")), F.col("rating")),
        "rating_count": count("rating_count"),
        "review_count": count("review_count"),
        "image": F.when(is_image(image), image),
        "url": url,
        "product_id": F.when(filled(trim(pid)), loose_id(pid)),
        "sponsored": _true(F.col("sponsored")) | _true(F.col("is_sponsored")),
        "source": source,
        "canonical_url": either(F.col("canonical_url"), url),
    }
