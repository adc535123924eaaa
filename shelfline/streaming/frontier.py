"""Many searches crawled at once over stored pages.

The frontier is a table of the pages that the searches ask for next.  A round
refuses what may not be read, takes away what a search has visited, joins the
rest with the pages, and goes on from their next links: as many rounds as a
search may read pages, each for all searches together.  A page is parsed once,
however many searches read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions import urls
from shelfline.functions.lexicon import MAX_PAGES
from shelfline.functions.text import asked, relevance_between
from shelfline.operators.dedup import deduplicate
from shelfline.operators.filters import organic, validate
from shelfline.operators.ranking import with_rank
from shelfline.plans.storage import stored
from shelfline.schema import raw_products
from shelfline.sources.sites import CARD_BITS, extract_products, scan_pages


def page_links(pages: DataFrame) -> DataFrame:
    """canonical, page, next_url, next_canonical and found_query of ``pages``
    (page_id, url, html), each page identity once, with the smallest id."""
    # Each URL is worked out once: a filter on it would do so again.
    there = F.filter(F.array(urls.canonical_page_of_site(F.col("url"))), lambda c: c != "")
    own = pages.select(F.explode(there).alias("canonical"), F.col("page_id").cast("bigint").alias("page"))
    first = own.groupBy("canonical").agg(F.min("page").alias("page"))
    scanned = scan_pages(pages).select("page", F.col("next_page_url").alias("next_url"), F.nullif(F.col("search_query"), F.lit("")).alias("found_query"))
    # Rows that share an id are one page.
    found = stored(scanned.groupBy("page").agg(F.min("next_url").alias("next_url"), F.min("found_query").alias("found_query")), "scanned")
    return first.join(found, "page").withColumn("next_canonical", urls.canonical_page_of_site(F.col("next_url")))


@dataclass(frozen=True)
class Crawled:
    """``visits``: search, step (from 1), canonical, page and next_url.
    ``searches``: search, query, low, high, pages (read) and ended: "bound",
    "no-link", "visited", "no-page", or why the next page was refused."""

    visits: DataFrame
    searches: DataFrame

    def products(self, pages: DataFrame) -> DataFrame:
        """search and the raw rows of the pages that it read, in their order."""
        read = pages.join(self.visits.select(F.col("page").alias("page_id")).distinct(), "page_id", "left_semi")
        found = stored(raw_products(extract_products(read)), "crawled-products")
        found = found.withColumn("page", F.shiftright("ordinal", CARD_BITS)).withColumn("card", F.col("ordinal") % (1 << CARD_BITS))
        rows = self.visits.select("search", "step", "page").join(found, "page")
        return rows.withColumn("ordinal", F.col("step") * (1 << CARD_BITS) + F.col("card")).drop("page", "step", "card")

    def ranked(self, pages: DataFrame) -> DataFrame:
        """The ranking of each search, by its own query and budget."""
        valid = validate(deduplicate(self.products(pages), within=["search"]), keep=["search"])
        rules = self.searches.select("search", asked(F.col("query")).alias("asked"), "low", "high")
        judged = valid.join(rules, "search").withColumn("relevance", relevance_between(F.col("title"), F.col("asked")))
        some = F.col("low").isNotNull() | F.col("high").isNotNull()
        fits = F.coalesce(F.col("price") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("price") <= F.col("high"), F.lit(True)) & (F.col("price") != 0)
        kept = judged.where((F.col("relevance.category") != "LOW") & (~some | F.coalesce(fits, F.lit(False))))
        return with_rank(organic(kept).drop("asked", "low", "high", "relevance"), ["search"])


def crawl(searches: DataFrame, pages: DataFrame, most: int = MAX_PAGES) -> Crawled:
    """Crawls ``searches`` (search, url, query, low, high) over ``pages``
    (page_id, url, html).

    A search keeps its query; one without takes that of the first page that
    names one.  Its first URL is taken as it is; a later one must be admitted
    by it, and not have been visited.  A page that is not there ends the
    search and loses nothing.  At most ``most`` pages are read a search.
    """
    links = stored(page_links(pages), "page-links")
    frontier = searches.select("search", F.col("url").alias("origin"), "url", F.lit(None).cast("string").alias("found"))
    frontier = frontier.withColumn("canonical", urls.canonical_page_of_site(F.col("url"))).withColumn("reason", F.when(F.coalesce(F.col("canonical"), F.lit("")) == "", "empty"))
    frontier, visits, ended = stored(frontier, "frontier"), None, None
    both = lambda a, b: b if a is None else a.unionByName(b)
    for step in range(1, most + 1):
        open_ = frontier.where("reason IS NULL")
        ended = both(ended, frontier.where("reason IS NOT NULL").select("search", "found", "reason"))
        read = stored(open_.join(links, "canonical", "left"), "frontier-pages")
        ended = both(ended, read.where("page IS NULL").select("search", "found", F.lit("no-page").alias("reason")))
        there = read.where("page IS NOT NULL").withColumn("found", F.coalesce("found", "found_query"))
        visits = both(visits, there.select("search", F.lit(step).alias("step"), "canonical", "page", "next_url"))
        onward = there.select("search", "origin", F.col("next_url").alias("url"), F.col("next_canonical").alias("canonical"), "found")
        # What the search has read in all rounds, each page once.
        seen = visits.select("search", "canonical", F.lit(True).alias("seen"))
        link = F.when(F.coalesce("canonical", F.lit("")) == "", "no-link").when(F.lit(step == most), "bound")
        refused = F.nullif(urls.admission(F.col("url"), F.col("origin")), F.lit("ok"))
        onward = onward.join(seen, ["search", "canonical"], "left").withColumn("reason", F.coalesce(link, refused, F.when(F.col("seen"), "visited")))
        frontier = stored(onward.select(frontier.columns), "frontier")
        if frontier.isEmpty():
            break
    ended = stored(both(ended, frontier.select("search", "found", "reason")), "ended")
    visits = stored(visits, "visits")
    counts = visits.groupBy("search").agg(F.count("*").alias("pages"))
    done = searches.join(ended, "search", "left").join(counts, "search", "left")
    done = done.select("search", F.coalesce(F.nullif(F.trim("query"), F.lit("")), "found").alias("query"), "low", "high", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("reason").alias("ended"))
    return Crawled(visits, stored(done, "searches"))
