"""Exact dedup against a persistent digest index.

The index has one row per distinct text (SHA-256 digest, id of the row that
stays): a table bucketed by digest with one sorted file a bucket, and beside it
a small table, bucketed alike, of what the last batches have added.  A batch is
reduced to one row per digest and merged with both by their buckets: the large
table is neither shuffled nor sorted, as its files say how they are ordered.
What the merge does not find is new and is appended.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm.common import free_names, shared_dir, stored

#: Java's regular expression for one run of white space.
WHITE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_RUN, " ")


def text_sha256(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


#: Digests that a bucket of a new or rewritten index holds, about; fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 1_000_000, 16
#: Batches after which the index is rewritten, a sorted file a bucket.
BATCHES = 16
#: Takes the order of a bucket's rows from its file, where it has only one.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class DigestIndex:
    """Digests seen so far, in two bucketed tables under ``path``.

    The folder outlives the session: opening it again finds what earlier
    batches wrote.  The number of buckets goes with the size of the first
    batch, or is as given, and is recorded with the index; opening it with
    another one is refused.  After BATCHES of them the index is rewritten in
    folders of its own, with buckets for its size by then.

    A batch's rows are appended before it is recorded.  A batch that was
    appended and not recorded is found when it is added again, and gives the
    same rows; an index whose first batch was not recorded is a new one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or shared_dir(spark, "digest-index")
        self.state, self.buckets, self.folder, self.recent, self.batches = 0, buckets, None, None, 0
        log = f"{self.path}/_state"
        at = spark._jvm.org.apache.hadoop.fs.Path(log)
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            last = spark.read.parquet(log).orderBy(F.desc("state")).first()
            if buckets not in (None, last.buckets):
                raise ValueError(f"the index has {last.buckets} buckets, not {buckets}")
            self.state, self.buckets, self.batches, self.folder, self.recent = last.state, last.buckets, last.batches, last.folder, last.recent

    def _table(self, folder: str) -> str:
        """The table of one folder of the index; the buckets say where its digests are."""
        name = "digest_index_" + hashlib.md5(f"{self.path}/{folder}".encode()).hexdigest()
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        self.spark.catalog.refreshTable(name)
        return name

    def _record(self) -> None:
        self.state += 1
        row = [(self.state, self.folder, self.recent, self.buckets, self.batches)]
        self.spark.createDataFrame(row, "state bigint, folder string, recent string, buckets int, batches int").coalesce(1).write.mode("append").parquet(f"{self.path}/_state")

    def _append(self, rows: DataFrame, folder: str) -> None:
        (
            rows.select("digest", "keep_id").repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").mode("append").saveAsTable(self._table(folder))
        )

    def _new(self, rows: DataFrame) -> None:
        """The whole index, in new folders: one sorted file a bucket."""
        number = uuid.uuid4().hex
        self.folder, self.recent = f"rows-{number}", f"recent-{number}"
        self._append(rows, self.folder)

    def rows(self) -> DataFrame:
        if self.folder is None:
            return self.spark.createDataFrame([], "digest binary, keep_id bigint")
        return self.spark.table(self._table(self.folder)).unionByName(self.spark.table(self._table(self.recent)))

    def compact(self) -> None:
        """Rewrites the index: one sorted file a bucket, buckets for its size.
        The old folders stay for who still reads them."""
        rows = self.rows()
        self.buckets, self.batches = max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS)), 1
        self._new(rows)
        self._record()

    @contextmanager
    def _ordered(self) -> Iterator[None]:
        old = self.spark.conf.get(ORDERED, "false")
        self.spark.conf.set(ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(ORDERED, old)

    def _met(self, groups: DataFrame) -> DataFrame:
        """``groups`` (a row a digest) with whether the index has seen the text,
        and the id that stays."""
        known = lambda folder, k: self.spark.table(self._table(folder)).select("digest", F.col("keep_id").alias(f"id_{k}"), F.lit(True).alias(f"in_{k}")).hint("merge")
        met = groups.join(known(self.folder, 0), "digest", "left").join(known(self.recent, 1), "digest", "left")
        keep_id = F.when(F.col("in_0"), F.col("id_0")).when(F.col("in_1"), F.col("id_1")).otherwise(F.col("first_id"))
        seen = F.coalesce("in_0", "in_1", F.lit(False))
        return met.select(*groups.columns, seen.alias("seen"), keep_id.alias("keep_id"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch; returns doc_id, digest (binary), keep_id,
        group_size and kept of each of its rows.

        Of equal texts within the batch the smallest id stays, unless the
        index knows the text: then the id in the index.  group_size counts
        the batch's rows of that text.  Null texts equal the empty text.  A
        null id stays only where no other id has the text.  Of repeated rows
        (same id and text) one is kept.  Only ``id_col`` and ``text_col`` are
        read.  An empty batch adds and returns nothing.
        """
        read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(text_sha256(F.col(text_col))).alias("digest"))
        # The number of a row, once written, tells repeated rows apart.
        keyed = stored(read.withColumn("row", F.monotonically_increasing_id()), "digests")
        first_row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
        groups = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), first_row.alias("first_row"), F.count("*").alias("group_size"))
        if self.batches >= BATCHES:
            self.compact()
        # A known text's id may be null, where only rows without an id had it.
        if self.folder is None:
            known = stored(groups.withColumns({"seen": F.lit(False), "keep_id": F.col("first_id")}), "known-digests")
            self.buckets = self.buckets or max(LEAST_BUCKETS, -(-known.count() // BUCKET_ROWS))
            self._new(known)
        else:
            with self._ordered():
                known = stored(self._met(groups), "known-digests")
            self._append(known.where("NOT seen"), self.recent)
        self.batches += 1
        self._record()
        # One row a digest on the right; a hot text's rows on the left are split by AQE's skew handling.
        kept = (F.col("row") == F.col("first_row")) & F.col("first_id").eqNullSafe(F.col("keep_id"))
        return keyed.join(known.drop("seen"), "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def keep_first(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :meth:`DigestIndex.add` keeps, all columns as
    they are."""
    index = index or DigestIndex(docs.sparkSession)
    own_id, own_digest, text, row = free_names(docs, "id", "digest", "text", "row")
    judged = stored(index.add(docs, id_col, text_col).select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest), "kept"), "judged")
    gone = judged.where("not kept").select(own_id)
    this = F.col(id_col).cast("bigint").eqNullSafe(F.col(own_id))
    if judged.groupBy(own_id).count().where("count > 1").isEmpty():
        return docs.join(gone.hint("merge"), this, "left_anti")
    # Rows of one id: the first of each text that stays.
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(id_col).cast("bigint").alias("doc"), F.unhex(text_sha256(F.col(text_col))).alias(text))
    kept = judged.where("kept").select(own_id, own_digest).distinct()
    same = F.col("doc").eqNullSafe(F.col(own_id)) & (F.col(text) == F.col(own_digest))
    return marked.join(kept, same, "left_semi").groupBy("doc", text).agg(F.first(row).alias(row)).select(f"{row}.*")
