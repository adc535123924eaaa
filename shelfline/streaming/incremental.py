"""Pages that arrive one after another.

Ranks are never patched: they are those of all rows so far, so a late page can
hold the first rank.  What fails or adds nothing leaves earlier results as
they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from shelfline.functions import urls
from shelfline.functions.lexicon import MAX_PAGES
from shelfline.operators.dedup import append
from shelfline.plans.pipeline import rank_products
from shelfline.plans.storage import shared_dir, stored
from shelfline.schema import raw_products
from shelfline.sources.sites import extract_products, scan_pages
from shelfline.streaming.state import RankState


@dataclass
class Crawl:
    """A search over its result pages, one after another.

    ``load`` gives the rows (page_id, url, html) of one URL.  The query and
    the budget stay those of the start; a page's query is taken only where
    none is known.  At most ``most`` pages are read, none twice.
    """

    spark: SparkSession
    load: Callable[[str], DataFrame]
    query: str | None = None
    low: float | None = None
    high: float | None = None
    most: int = MAX_PAGES
    origin: str | None = None
    pages: int = 0
    visited: set[str] = field(default_factory=set)
    raw: DataFrame | None = None
    next_url: str | None = None

    def _said(self, *columns: Column):
        """Values of one row, worked out by the same expressions as a table's."""
        return self.spark.range(1).select(*columns).first()

    def read(self, url: str) -> bool:
        """Reads a page; False, and nothing changes, if it is refused, was
        read before or gives no page."""
        canonical, reason = self._said(urls.canonical_page_of_site(F.lit(url)), urls.admission(F.lit(url), F.lit(self.origin)))
        if self.pages >= self.most or not canonical or canonical in self.visited or (self.pages and reason != "ok"):
            return False
        page = stored(self.load(url), "page")
        scan = scan_pages(page).first()
        if scan is None:
            return False
        fresh = stored(raw_products(extract_products(page)), "page-products")
        self.raw = stored(fresh if self.raw is None else append(self.raw, fresh), "raw-products")
        self.visited.add(canonical)
        self.pages += 1
        self.origin, self.query, self.next_url = self.origin or url, self.query or scan.search_query or None, scan.next_page_url
        return True

    def run(self, url: str) -> DataFrame | None:
        """Reads from ``url`` on as far as it goes; the ranking of all."""
        while url and self.read(url):
            url = self.next_url
        return self.ranked()

    def ranked(self) -> DataFrame | None:
        return None if self.raw is None else rank_products(self.raw, self.query, self.low, self.high)


def rank_stream(stream: DataFrame, folder: str, **options) -> DataStreamWriter:
    """Ranks a stream of raw product rows after each batch.

    A batch reads the state by key (:class:`RankState`) and itself, no earlier
    batch.  Its changes are written under its number, so one that is tried
    again replaces itself; the ranking after it goes to a folder of that
    number, written once; an empty one leaves no row there, so the last good
    one stays (:func:`last_ranking`).
    """
    ranked, state = f"{folder}/ranked", RankState(stream.sparkSession, f"{folder}/state", **options)
    # What there is before any batch: no row, but the columns of a ranking.
    none = stream.sparkSession.createDataFrame([], stream.schema)
    rank_products(none, **options).write.mode("overwrite").parquet(f"{ranked}/batch=-1")

    def each(batch: DataFrame, number: int) -> None:
        state.merge(batch, number)
        state.ranked(number).write.mode("overwrite").parquet(f"{ranked}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/progress")


def last_ranking(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The last ranking of :func:`rank_stream` that has rows, or the last up to
    a batch; no row, with the columns of one, where there was none."""
    every = spark.read.option("basePath", f"{folder}/ranked").parquet(f"{folder}/ranked/batch=*")
    if upto is not None:
        every = every.where(F.col("batch") <= upto)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == F.lit(last)).drop("batch")


def rank_batches(spark: SparkSession, batches: list[DataFrame], **options) -> list[DataFrame]:
    """Runs :func:`rank_stream` over batches that arrive one after another;
    the last good ranking after each of them."""
    folder = shared_dir(spark, "stream")
    arriving, out = f"{folder}/arriving", []
    batches[0].limit(0).write.parquet(arriving)
    query = rank_stream(spark.readStream.schema(batches[0].schema).parquet(arriving), folder, **options).start()
    try:
        for batch in batches:
            batch.write.mode("append").parquet(arriving)
            query.processAllAvailable()
            seen = query.lastProgress["batchId"] if query.lastProgress else -1
            out.append(last_ranking(spark, folder, seen))
    finally:
        query.stop()
    return out


def rank_files(spark: SparkSession, stream: DataFrame, **options) -> DataFrame:
    """Runs :func:`rank_stream` over what is there, and gives the last ranking;
    a stream without a file gives no row."""
    folder = shared_dir(spark, "stream")
    query = rank_stream(stream, folder, **options).trigger(availableNow=True).start()
    query.awaitTermination()
    return last_ranking(spark, folder)


def settle_times(events: DataFrame, key: str, at: str, is_trigger: Column, quiet: str, cap: str) -> DataFrame:
    """When each trigger's growth has settled: ``quiet`` after the last event
    that follows without a longer gap, ``cap`` after the trigger at the
    latest; with no event at all only the cap ends it.

    Events belong to the trigger of their key before them.  Returns key,
    started, settled and grown (events counted).
    """
    order = Window.partitionBy(key).orderBy(at)
    numbered = events.withColumn("__run", F.sum(is_trigger.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__run > 0")
    run = Window.partitionBy(key, "__run").orderBy(at)
    wait, most = F.expr(f"INTERVAL {quiet}"), F.expr(f"INTERVAL {cap}")
    staged = (
        numbered.withColumn("__start", F.first(at).over(run)).withColumn("__row", F.row_number().over(run)).withColumn("__gap", (F.col("__row") > 2) & (F.col(at) > F.lag(at).over(run) + wait))
        .withColumn("__late", F.max(F.col("__gap") | (F.col(at) > F.col("__start") + most)).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    )
    counted = (F.col("__row") > 1) & ~F.col("__late")
    grouped = staged.groupBy(key, F.col("__start").alias("started")).agg(F.max(F.when(counted, F.col(at))).alias("last"), F.count_if(counted).alias("grown"))
    return grouped.select(key, "started", F.least(F.col("started") + most, F.coalesce(F.col("last") + wait, F.col("started") + most)).alias("settled"), "grown")
