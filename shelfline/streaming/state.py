"""The ranking's state: one row a product key, kept as a log of changes.

A batch is reduced by key, merged with what the state knows of these keys, and
written as the batch's changes: a row with the best row so far and the key's
first ordinal, and another with the row as it would be ranked, unless a filter
takes it.  So the two are put side by side without a join.  A key is ranked if
its last change came with such a row.  Earlier
batches' raw rows are not read again, and only changed keys are validated and
scored.  After COMPACT batches the log is rewritten as one table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfline.operators.dedup import merit, product_key
from shelfline.operators.ranking import with_rank
from shelfline.plans.pipeline import filtered
from shelfline.plans.storage import stored
from shelfline.schema import raw_products

#: Batches after which the log is rewritten.
COMPACT = 16


def _reduced(rows: DataFrame) -> DataFrame:
    """The best row of each key and its first ordinal, of (key, first, merit, best)."""
    return rows.groupBy("key").agg(F.min("first").alias("first"), F.max_by("best", "merit").alias("best"), F.max("merit").alias("merit"))


class RankState:
    """A log under ``folder``.  The query and the budget are those of its
    start.  A batch that is tried again reads what was before it and replaces
    its own changes, so it counts once."""

    def __init__(self, spark: SparkSession, folder: str, query: str | None = None, low: float | None = None, high: float | None = None):
        self.spark, self.folder, self.options = spark, folder, (query, low, high)
        raw = raw_products(spark.createDataFrame([], "ordinal bigint"))
        self._shape = StructType([*self._changes(self._fresh(raw)).schema.fields, StructField("level", StringType()), StructField("batch", LongType())])

    def _fresh(self, batch: DataFrame) -> DataFrame:
        batch = raw_products(batch)
        return _reduced(batch.select(product_key().alias("key"), F.col("ordinal").alias("first"), merit().alias("merit"), F.struct(*batch.columns).alias("best")))

    def _changes(self, merged: DataFrame) -> DataFrame:
        """Beside them rows of their keys with what would be ranked."""
        merged = stored(merged, "changed-keys")
        rows = merged.select("key", "best.*", "first").withColumn("ordinal", F.col("first")).drop("first")
        ranked = filtered(rows, *self.options, keep=["key"])
        ranked = ranked.select("key", F.struct(*[c for c in ranked.columns if c != "key"]).alias("candidate"))
        return merged.select("key", "first", "merit", "best").unionByName(ranked, allowMissingColumns=True)

    def _log(self, upto: int) -> DataFrame | None:
        """The changes of all batches up to a number, with it; the last
        rewritten table and what came after it."""
        try:
            log = self.spark.read.schema(self._shape).option("basePath", self.folder).parquet(f"{self.folder}/level=*")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None  # no batch yet
            raise
        log = log.where(F.col("batch") <= upto)
        base = log.where("level = 'whole'").agg(F.max("batch")).first()[0]
        return log.where((F.col("level") == "change") & (F.col("batch") > F.lit(-1 if base is None else base)) | (F.col("level") == "whole") & (F.col("batch") == F.lit(base)))

    def _last(self, log: DataFrame, *columns: str) -> DataFrame:
        """Of each key what the last batch that changed it left: ``columns``
        of its state, and the candidate where that batch has one."""
        # Organic or not is said of every best row; a part of it is enough to read.
        changed = F.when(F.col("merit.organic").isNotNull(), F.col("batch"))
        offered = F.when(F.col("candidate").isNotNull(), F.col("batch"))
        last = log.groupBy("key").agg(
            F.max(changed).alias("changed"), F.max(offered).alias("offered"), F.max_by("candidate", offered).alias("candidate"),
            *[F.max_by(F.struct(*columns), changed).alias("s")] * bool(columns),
        )
        return last.select("key", *["s.*"] * bool(columns), F.when(F.col("offered") == F.col("changed"), F.col("candidate")).alias("candidate"))

    def merge(self, batch: DataFrame, number: int) -> None:
        fresh = stored(self._fresh(batch), "batch-keys")
        log = self._log(number - 1)
        if log is not None:
            known = self._last(log.where("best is not null").join(fresh.select("key"), "key", "left_semi"), "first", "merit", "best")
            fresh = _reduced(fresh.unionByName(known.drop("candidate")))
        self._changes(fresh).write.mode("overwrite").parquet(f"{self.folder}/level=change/batch={number}")
        if number % COMPACT == COMPACT - 1:
            self._last(self._log(number), "first", "merit", "best").write.mode("overwrite").parquet(f"{self.folder}/level=whole/batch={number}")

    def candidates(self, number: int) -> DataFrame:
        """The rows that are ranked after batch ``number``."""
        return self._last(self._log(number)).where("candidate IS NOT NULL").select("candidate.*")

    def ranked(self, number: int) -> DataFrame:
        return with_rank(self.candidates(number))
