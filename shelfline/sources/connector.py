"""The format "shop_pages": stored search pages, read as node rows.

``spark.read.format("shop_pages").load(path)`` reads Parquet files of pages
(page_id, url, html; the options ``page``, ``url`` and ``html`` name other
columns) and gives the node rows of their cards, which ``products_of`` turns
into products.  Each row group of each file is a partition of its own; only
the three columns are read.  The path is one that PyArrow can open; pages in
other stores are read by Spark and given to ``extract_products``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from shelfline.functions.urls import site_name
from shelfline.sources.nodes import NODE, Spec, node_batches
from shelfline.sources.sites import card_specs, products_of

FORMAT = "shop_pages"
#: Pages parsed at once by a task.
PAGES = 256


class RowGroup(InputPartition):
    def __init__(self, path: str, number: int):
        super().__init__(path)
        self.path, self.number = path, number


class ShopPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"{NODE}, reader string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Pages(dict(self.options), schema, card_specs())


class _Pages(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType, specs: dict[str, Spec]):
        self.path, self.schema, self.specs = options["path"], schema, specs
        self.columns = [options.get(c, d) for c, d in (("page", "page_id"), ("url", "url"), ("html", "html"))]

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = self._files()
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and not f.base_name.startswith(("_", ".")))
        groups = []
        for file in files:
            with store.open_input_file(file) as f:
                groups += [RowGroup(file, k) for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
        return groups

    def read(self, partition: RowGroup | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # there is no file
            return
        store, _ = self._files()
        with store.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(PAGES, row_groups=[partition.number], columns=self.columns):
                page, url, html = (batch.column(c).to_pylist() for c in self.columns)
                sites = [site_name(u) for u in url]
                rows = zip(page, [s if s in self.specs else "Amazon" for s in sites], html, strict=True)
                yield from node_batches(rows, self.specs, to_arrow_schema(self.schema))


def read_products(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Raw product rows of the pages stored at a path."""
    spark.dataSource.register(ShopPages)
    return products_of(spark.read.format(FORMAT).options(**options).load(path))
