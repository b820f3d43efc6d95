"""Tables bucketed by ticker in the catalog: windows, aggregates and joins on ticker need no shuffle.

``CatalogStore`` is a ``Store`` whose folders are also registered as tables that are ``CLUSTERED BY (ticker)`` and
``SORTED BY (ticker, date)``. The bucket number of a folder (``ticker_bucket=``) is Spark's own bucket of the
ticker, so a folder holds one bucket only, and the sinks go on rewriting single (year, bucket) folders. A scan hands
all files of a bucket to one task and tells the planner so: the ratio table, screens and price-with-TTM joins of two stored
tables run from scan to result without an exchange.

A bucket is one task in such a scan. Where one ticker makes its bucket much larger than the others (``hot_factor``
times the mean and more than ``hot_bytes``), the table is read as plain files instead: Spark splits them, every task reduces
its part first, and the shuffle moves a row per ticker and task. The results are the same. Sizes come from a listing of
the files, one row per bucket, taken once per Store and after its own writes.

The catalog of a session without a metastore forgets its tables; they are registered again from the folder when first read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.functions.scalar import TICKER_BUCKETS, spark_bucket
from tickwise.sources.store import TABLES, Store


class CatalogStore(Store):
    """A root folder of tickwise tables that are bucketed tables of the session's catalog."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = TICKER_BUCKETS, namespace: str = "default",
                 hot_factor: float = 8.0, hot_bytes: int = 512 << 20):
        """All tables of a root should have one number of ``buckets``, or their joins shuffle one side."""
        super().__init__(spark, root, "bucketed", buckets)
        self.namespace, self.hot_factor, self.hot_bytes = namespace, hot_factor, hot_bytes

    def table_name(self, table: str) -> str:
        """The catalog's name of a table; the root is part of it."""
        return f"{self.namespace}.tickwise_{hashlib.sha256(self.root.encode()).hexdigest()[:12]}_{TABLES[table]}"

    def bucket_of(self, ticker, buckets: int, table: str | None = None) -> Column:
        """Spark's bucket: the hash that ``CLUSTERED BY`` uses."""
        return spark_bucket(ticker, buckets)

    def _hash(self, table: str) -> str:
        return "hash"

    def hot(self, table: str) -> bool:
        """Is a bucket so much larger than the others that one task should not read it?"""
        sizes = [r.bytes for r in (
            self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.path(table))
            .groupBy("ticker_bucket").agg(F.sum("length").alias("bytes")).collect())]  # a row per bucket
        return bool(sizes) and max(sizes) > self.hot_bytes and max(sizes) * self.buckets(table) > self.hot_factor * sum(sizes)

    def _register(self, table: str) -> str:
        """Make the folder a table of the catalog, unless it is one."""
        name, schema = self.table_name(table), self._schemas[table]
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"""CREATE TABLE {name} ({columns}) USING parquet
                PARTITIONED BY ({", ".join(self.partition_cols(table))})
                CLUSTERED BY (ticker) SORTED BY ({", ".join(self._sort_cols(table))}) INTO {self.buckets(table)} BUCKETS
                LOCATION '{self.path(table)}'""")
            if self._has_files(self.path(table)):
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        added = [f for f in schema.fields if f.name not in self.spark.table(name).columns]
        if added:
            self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS "
                           f"({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in added)})")
        return name

    def _raw(self, table: str) -> DataFrame:
        return super()._raw(table) if self.hot(table) else self.spark.table(self._register(table))

    def _save(self, out: DataFrame, table: str, replace: bool) -> None:
        name = self._register(table)
        columns = [F.col(f"`{f.name}`") if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name)
                   for f in self.spark.table(name).schema.fields]
        with self._setting("spark.sql.sources.partitionOverwriteMode", "dynamic"):  # only partitions that receive rows
            out.select(*columns).write.insertInto(name, overwrite=replace)

    def _drop_partition(self, table: str, values: tuple) -> None:
        spec = ", ".join(f"{c}={v}" for c, v in zip(self.partition_cols(table), values, strict=True))
        self.spark.sql(f"ALTER TABLE {self._register(table)} DROP IF EXISTS PARTITION ({spec})")
        super()._drop_partition(table, values)

    def refresh(self) -> None:
        for table in TABLES:
            if self.spark.catalog.tableExists(self.table_name(table)):
                self.spark.catalog.recoverPartitions(self.table_name(table))
                self.spark.catalog.refreshTable(self.table_name(table))
        super().refresh()
