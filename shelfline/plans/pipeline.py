"""The ranking as one plan, lazy but for the ranks of all rows, which are
worked out in written tables.

Raw rows are deduplicated, validated, filtered by relevance, budget and
sponsorship, and ranked by feedback volume.  Duplicates are settled before the
filters, as a filter must not choose among copies; the three filters commute.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.formatting import card_html, position_text
from shelfline.functions.lexicon import PAGE_SIZE
from shelfline.operators.dedup import deduplicate
from shelfline.operators.filters import in_budget, organic, relevant, validate
from shelfline.operators.insights import price_stats
from shelfline.operators.ranking import page, with_rank
from shelfline.schema import raw_products


def candidates(raw: DataFrame, query: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """The rows that are ranked."""
    return filtered(deduplicate(raw_products(raw)), query, low, high)


def filtered(unique: DataFrame, query: str | None = None, low: float | None = None, high: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Those of products without duplicates that are ranked, with the columns
    ``keep`` as they are."""
    return organic(in_budget(relevant(validate(unique, keep), query), low, high))


def rank_products(raw: DataFrame, query: str | None = None, low: float | None = None, high: float | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """All candidates with feedback_volume, rank and page."""
    return with_rank(candidates(raw, query, low, high), partition_by)


def ranked_page(raw: DataFrame, number: int, query: str | None = None, low: float | None = None, high: float | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """One display page: a top-k, not a sort of everything."""
    return page(candidates(raw, query, low, high), number, size)


def cards(raw: DataFrame, number: int, query: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """rank and html of the cards of a display page."""
    rows = candidates(raw, query, low, high)
    both = page(rows, number).crossJoin(F.broadcast(price_stats(rows).select("lowest", "average")))  # one row
    columns = [F.col(c) for c in ("rank", "title", "url", "canonical_url", "image", "source", "price", "review_count", "rating_count", "rating")]
    return both.select("rank", card_html(*columns, position_text(F.col("price"), F.col("lowest"), F.col("average"))).alias("html"))
