"""Partitioned Parquet tables: scans and the replace / upsert / delete sinks.

Layout (default ``"bucketed"``)::

    <root>/prices/year=Y/ticker_bucket=B/part-*.parquet        rows sorted by (ticker, date)
    <root>/fundamentals_quarterly/ticker_bucket=B/part-*.parquet
    <root>/fundamentals_annual/ticker_bucket=B/part-*.parquet
    <root>/metadata/<name>/part-*.parquet

``ticker_bucket = pmod(hash(ticker), n)``, the bucket of Spark's own bucketed tables; ``n``, the
hash and the columns are kept in ``<table>/_layout.json``, so any reader prunes by the number the
table was written with (older tables by xxhash64) and no scan has to merge file footers. A ticker filter adds the bucket
predicate, so one ticker reads 1/n of the directories and Parquet min/max
statistics on the sorted ticker column skip most row groups. The
reference layout (``ticker=`` / ``ticker=/year=``) is available as
``layout="ticker"``; it makes one directory per ticker, which at tens of
thousands of tickers means hundreds of thousands of small files.

Replace rule M: a partition holds many tickers, so overwriting it with only
the new rows would drop its other tickers. Every sink therefore reads the
touched partitions, removes the replaced keys with a left-anti join (or keeps
the newest row per key for upserts), unions the new rows and writes them with
dynamic partition overwrite: its job writes beside the files it reads and
replaces folders when it commits. An incoming batch is staged once under the
root, so its source is read once; its rows are gathered by folder for that, and
from then on stay in the tasks that read them. Partitions that end up empty
are removed explicitly, since dynamic overwrite only replaces partitions that
receive rows. A batch that both rewrites and adds partitions commits twice;
replaying it after a failure in between gives the same table.
"""

from __future__ import annotations

import json
import logging
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.functions.scalar import TICKER_BUCKETS, spark_bucket, ticker_bucket
from tickwise.operators.filters import filter_date_range, project_columns
from tickwise.operators.ratios import ticker_names
from tickwise.operators.sets import dedupe_keep_last, source_position
from tickwise.schemas import FUNDAMENTALS, PRICE_KEYS, PRICES

log = logging.getLogger(__name__)

TABLES = {"prices": "prices", "quarterly": "fundamentals_quarterly",
          "annual": "fundamentals_annual"}


FEW_KEYS = 1_000_000  # keys that a join may hold whole in every executor, some tens of MB

# two sides that were dealt alike by some of a join's keys are joined as they lie
DEALT_JOINS = "spark.sql.requireAllClusterKeysForCoPartition", "false"


class Store:
    """A root folder of tickwise tables (local path or any Hadoop URI)."""

    def __init__(self, spark: SparkSession, root: str, layout: str = "bucketed",
                 buckets: int = TICKER_BUCKETS):
        """``buckets`` holds for tables that do not exist yet; others keep their own number."""
        if layout not in ("bucketed", "ticker"):
            raise ValueError("layout must be 'bucketed' or 'ticker'")
        self.spark, self.root, self.layout, self.new_buckets = spark, root.rstrip("/"), layout, buckets
        self._buckets: dict[str, int] = {}
        self._hashes: dict[str, str] = {}
        # resolved file schema per table: merged once, then kept current by this
        # Store's own writes, so repeated scans skip the footer-merge job
        self._schemas: dict[str, T.StructType] = {}
        # base scan per table (its file index is listed once); dropped on own writes
        self._frames: dict[str, DataFrame] = {}

    def refresh(self) -> None:
        """Forget cached listings and schemas (after writes by another process)."""
        self._schemas.clear()
        self._frames.clear()
        self._buckets.clear()
        self._hashes.clear()

    # ------------------------------------------------------------------ paths / fs
    def path(self, table: str) -> str:
        if table not in TABLES:
            raise ValueError(f"Unknown data_type: {table}")
        return f"{self.root}/{TABLES[table]}"

    def metadata_path(self, name: str) -> str:
        return f"{self.root}/metadata/{name}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return p.getFileSystem(conf), p

    def _has_files(self, path: str) -> bool:
        """Does the folder hold data? One non-recursive listing: any partition
        folder or data file (names not starting with '_' or '.')."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return False
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if not name.startswith(("_", ".")):
                return True
        return False

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        if fs.exists(p):
            fs.delete(p, True)

    @contextmanager
    def _setting(self, key: str, value: str):
        """A setting of the session, for the writes inside."""
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, value)
        try:
            yield
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)

    @contextmanager
    def _staged(self, df: DataFrame):
        """The rows of ``df`` as a table under the root, removed afterwards."""
        path = f"{self.root}/_staging/{uuid.uuid4().hex}"
        try:
            df.write.option("compression", "zstd").parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            self._delete(path)

    @contextmanager
    def _keys_of(self, new: DataFrame, keys: list[str], unique: bool):
        """Keys of a staged batch: plain reads, so that Spark can split the joins with them.

        A batch has one row per upsert key, so those are read off the batch; others are staged once each.
        """
        if unique:
            yield self._if_few(new.select(*keys))
            return
        with self._staged(new.select(*keys).distinct()) as gone:
            yield self._if_few(gone)

    def _if_few(self, staged: DataFrame) -> tuple[DataFrame, bool]:
        """A stored frame of keys, marked for broadcast if all of it is small (``FEW_KEYS`` rows, counted off its footers); is it?"""
        few = staged.count() <= FEW_KEYS
        return (F.broadcast(staged) if few else staged), few

    def _without(self, rows: DataFrame, gone: DataFrame, keys: list[str], few: bool, table: str) -> tuple[DataFrame, bool]:
        """Rows read from folders, less those with a key of ``gone``; did that move them away from their folders' others?

        Beside few keys the rows stay where they are read. Otherwise both sides are dealt by ticker over a multiple of the
        table's buckets: the join needs nothing else (under ``DEALT_JOINS``), and a task then holds tickers of one bucket.
        """
        if few:
            return rows.join(gone, keys, "left_anti"), False
        n = self.buckets(table)
        n *= -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // n)
        # an anti join would be planned below the dealing, and move rows once more
        both = rows.repartition(n, "ticker").join(gone.repartition(n, "ticker").withColumn("_gone", F.lit(True)), keys, "left")
        return both.where("_gone is null").select(*rows.columns), self.layout == "bucketed" and self._hash(table) == "xxhash64"

    @contextmanager
    def transaction(self):
        """Writes inside belong together; only a ``VersionedStore`` makes them visible at once."""
        yield

    # ------------------------------------------------------------------ layout file
    def _layout_path(self, table: str) -> str:
        return f"{self.path(table)}/_layout.json"

    def _load_layout(self, table: str) -> None:
        """Bucket number and columns that were stored with the table."""
        fs, p = self._fs(self._layout_path(table))
        if table in self._schemas or not fs.exists(p):
            return
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        kept = json.loads(text)
        self._buckets[table] = kept["buckets"]
        self._hashes[table] = kept.get("hash", "xxhash64")
        self._schemas[table] = T.StructType.fromJson(kept["columns"])

    def _store_layout(self, table: str) -> None:
        fs, p = self._fs(self._layout_path(table))
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(json.dumps(
                {"buckets": self.buckets(table), "hash": self._hash(table), "columns": self._schemas[table].jsonValue()}), "utf-8"))
        finally:
            stream.close()

    def buckets(self, table: str) -> int:
        """The bucket number a table was written with (a new table: the Store's)."""
        self._load_layout(table)
        if table not in self._buckets:
            self._buckets[table] = self.new_buckets
        return self._buckets[table]

    def _hash(self, table: str) -> str:
        """The hash a table's buckets were made with (a new table: Spark's own)."""
        self._load_layout(table)
        if table not in self._hashes:
            self._hashes[table] = "xxhash64" if self._has_files(self.path(table)) else "hash"
        return self._hashes[table]

    # ------------------------------------------------------------------ layout
    def bucket_of(self, ticker, buckets: int, table: str | None = None) -> Column:
        """The bucket of a ticker (a column or its name), in ``table`` or in a new one."""
        if table is not None and self._hash(table) == "xxhash64":
            return ticker_bucket(ticker, buckets)
        return spark_bucket(ticker, buckets)

    def partition_cols(self, table: str) -> list[str]:
        if self.layout == "ticker":
            return ["ticker", "year"] if table == "prices" else ["ticker"]
        return ["year", "ticker_bucket"] if table == "prices" else ["ticker_bucket"]

    def _schema(self, table: str) -> T.StructType:
        return PRICES if table == "prices" else FUNDAMENTALS

    def _sort_cols(self, table: str) -> list[str]:
        return ["ticker", "date"] if table == "prices" else ["ticker", "fiscal_period"]

    # ------------------------------------------------------------------ scans
    def read(self, table: str) -> DataFrame:
        """All rows of a table, canonical types, columns the files actually carry.

        An absent or empty table gives an empty frame *with* the canonical
        schema (D9 fix). ``ticker_bucket`` is kept for pruning; scans drop it.
        """
        if table in self._frames:
            return self._frames[table]
        path = self.path(table)
        schema = self._schema(table)
        if not self._has_files(path):
            return self.spark.createDataFrame([], schema)
        self._load_layout(table)
        if table not in self._schemas:  # files without a layout file: merge their footers once
            try:
                found = self.spark.read.option("mergeSchema", "true").parquet(path).schema
            except AnalysisException:  # folder without data files
                return self.spark.createDataFrame([], schema)
            self._schemas[table] = self._with_typed_partitions(table, found)
        raw = self._raw(table)
        known = {f.name: f.dataType.simpleString() for f in schema.fields}
        known["ticker_bucket"] = "int"
        order = [f.name for f in schema.fields if f.name in raw.columns]
        rest = [c for c in raw.columns if c not in known or c == "ticker_bucket"]
        exprs = [f"CAST(`{c}` AS {known[c]}) AS `{c}`" if c in known else f"`{c}`"
                 for c in order + rest]
        df = raw.selectExpr(*exprs)
        self._frames[table] = df
        return df

    def _raw(self, table: str) -> DataFrame:
        """The files of a table as they are, its columns known."""
        return self.spark.read.schema(self._schemas[table]).parquet(self.path(table))

    def _with_typed_partitions(self, table: str, found: T.StructType) -> T.StructType:
        """Partition columns get their declared types: tickers such as 007 or 1E5 are strings."""
        types = {"ticker": T.StringType(), "year": T.LongType(), "ticker_bucket": T.IntegerType()}
        pcols = self.partition_cols(table)
        plain = [f for f in found.fields if f.name not in pcols]
        return T.StructType(plain + [T.StructField(c, types[c]) for c in pcols])

    def _ticker_filter(self, df: DataFrame, table: str, ticker) -> DataFrame:
        """Rows of one ticker (str), of a list or of a frame with ``ticker``.

        Names add the bucket predicate, constants that reach the partition filter, so only the
        matching ``ticker_bucket=`` directories are listed and read; a frame is semi-joined.
        """
        tickers = ticker_names(ticker)
        if tickers is None:
            return df
        if isinstance(tickers, DataFrame):
            return df.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
        if "ticker_bucket" in df.columns:
            n = self.buckets(table)
            df = df.where(F.col("ticker_bucket").isin([self.bucket_of(F.lit(t), n, table) for t in tickers]))
        if len(tickers) == 1:
            return df.where(F.col("ticker") == F.lit(tickers[0]))
        return df.where(F.col("ticker").isin(tickers))

    def scan_prices(self, ticker: str | None = None, start_date=None, end_date=None,
                    columns: list[str] | None = None) -> DataFrame:
        df = self._ticker_filter(self.read("prices"), "prices", ticker)
        df = filter_date_range(df, start_date, end_date)
        df = df.drop("ticker_bucket")
        return project_columns(df, columns, ("ticker", "date"))

    def scan_fundamentals(self, period: str = "quarterly", ticker: str | None = None,
                          columns: list[str] | None = None) -> DataFrame:
        df = self._ticker_filter(self.read(period), period, ticker).drop("ticker_bucket")
        return project_columns(df, columns, ("ticker",))

    def scan_fundamentals_quarterly(self, ticker=None, columns=None) -> DataFrame:
        return self.scan_fundamentals("quarterly", ticker, columns)

    def scan_fundamentals_annual(self, ticker=None, columns=None) -> DataFrame:
        return self.scan_fundamentals("annual", ticker, columns)

    def _metadata_generations(self, name: str) -> list[int]:
        """Finished writes of a named table, oldest first (Spark marks a finished one with ``_SUCCESS``)."""
        fs, p = self._fs(self.metadata_path(name))
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        numbers = [int(n[4:]) for n in names if n.startswith("gen=") and n[4:].isdigit()]
        return sorted(n for n in numbers if fs.exists(self._fs(f"{self.metadata_path(name)}/gen={n}/_SUCCESS")[1]))

    def read_metadata(self, name: str) -> DataFrame:
        """A named metadata table; an empty frame when it does not exist."""
        path, done = self.metadata_path(name), self._metadata_generations(name)
        if done:
            return self.spark.read.parquet(f"{path}/gen={done[-1]}")
        log.warning("Metadata table not found: %s", path)
        return self.spark.createDataFrame([], T.StructType([]))

    # ------------------------------------------------------------------ sinks
    def _prepare(self, df: DataFrame, table: str, ticker: str | None) -> DataFrame:
        if "ticker" not in df.columns:
            if ticker is None:
                raise ValueError("frame has no ticker column and no ticker was given")
            df = df.withColumn("ticker", F.lit(ticker))
        if table == "prices" and "year" not in df.columns:
            df = df.withColumn("year", F.year("date").cast("bigint"))
        if self.layout == "bucketed":
            df = df.withColumn("ticker_bucket", self.bucket_of("ticker", self.buckets(table), table))
        schema = self._schema(table)
        known = {f.name: f.dataType for f in schema.fields}
        df = df.select(*[F.col(c).cast(known[c]).alias(c) if c in known else F.col(c)
                         for c in df.columns])
        # D13: key columns are non-null in stored tables
        keys = PRICE_KEYS if table == "prices" else ["ticker", "fiscal_period"]
        return df.dropna(subset=[k for k in keys if k in df.columns])

    def _touched(self, new: DataFrame, table: str) -> list[tuple]:
        """Distinct partition values of the incoming rows (bounded by the partition count)."""
        pcols = self.partition_cols(table)
        return [tuple(r) for r in new.select(*pcols).distinct().collect()]

    def _in_partitions(self, df: DataFrame, table: str, parts: list[tuple]) -> DataFrame:
        pcols = self.partition_cols(table)
        if not parts:
            return df.limit(0)
        if len(pcols) == 1:
            return df.where(F.col(pcols[0]).isin([p[0] for p in parts]))
        types = {c: df.schema[c].dataType for c in pcols}
        key = F.struct(*[F.col(c) for c in pcols])
        return df.where(key.isin([F.struct(*[F.lit(v).cast(types[c]).alias(c)
                                             for c, v in zip(pcols, p)]) for p in parts]))

    def _write(self, out: DataFrame, table: str, moved: bool = True) -> None:
        """Replace the partitions of ``out``, which may read them: they go when the job commits."""
        self._remember_schema(table, out)
        self._save(self._layout_for_write(out, table, moved), table, replace=True)
        self._store_layout(table)

    def _save(self, out: DataFrame, table: str, replace: bool) -> None:
        """Write rows into their partitions, instead of what is there or beside it."""
        (out.write.mode("overwrite" if replace else "append").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy(*self.partition_cols(table)).parquet(self.path(table)))

    def _remember_schema(self, table: str, out: DataFrame) -> None:
        """Union of the table's columns and those being written."""
        self._load_layout(table)
        if table not in self._schemas and self._has_files(self.path(table)):
            self.read(table)
        old = self._schemas.get(table, T.StructType([]))
        names = {f.name for f in old.fields}
        self._schemas[table] = self._with_typed_partitions(
            table, T.StructType(old.fields + [f for f in out.schema.fields if f.name not in names]))
        self._frames.pop(table, None)

    def _batch(self, df: DataFrame, table: str, ticker: str | None, order_col: str | None,
               watch: tuple | None) -> DataFrame:
        """Incoming rows as they will be stored: non-null keys, one row per key.

        Of a repeated key the row with the highest ``order_col`` stays; without one the last row of the
        batch's files, where the frame is a scan of files; else a deterministic choice.
        ``watch`` is a pair of Observations: rows that came in, rows that are left.
        """
        placed = None if order_col else source_position(df, "_position")
        if placed is not None:
            df = placed
        if watch:
            df = df.observe(watch[0], F.count(F.lit(1)).alias("n"))
        df = self._prepare(df, table, ticker)
        seq = F.col(order_col) if order_col else F.col("_position") if placed is not None else F.lit(0)
        if table == "prices":
            keys = PRICE_KEYS
        else:  # of two fiscal years for one period end the later one holds
            keys = ["ticker", "fiscal_period"]
            seq = F.struct(F.col("fiscal_year") if "fiscal_year" in df.columns else F.lit(0), seq.alias("seq"))
        df = dedupe_keep_last(df.withColumn("_seq", seq).drop("_position"), keys, "_seq", unique=placed is not None).drop("_seq")
        if order_col:
            df = df.drop(order_col)   # a batch tie-breaker, not a table column
        return df.observe(watch[1], F.count(F.lit(1)).alias("n")) if watch else df

    def _replace(self, df: DataFrame, table: str, keys: list[str], ticker: str | None,
                 upsert_keys: list[str] | None = None, order_col: str | None = None,
                 watch: tuple | None = None, clustered: bool = False) -> int:
        batch = self._batch(df, table, ticker, order_col, watch)
        self._about_to_change(table)
        if not self._has_files(self.path(table)):
            # fresh table: nothing to merge, so no need to find touched partitions first
            self._write(batch, table, moved=not clustered)
            n = self._count_partitions(table)
            if n == 0:
                log.warning("Empty frame for %s, nothing written", table)
                self._delete(self.path(table))
                self.refresh()
            self._changed(table, self.read(table), upsert_keys is not None)
            return n
        key_cols = upsert_keys or keys
        with self._staged(self._gathered(batch, table, clustered)) as new, self._keys_of(new, key_cols, upsert_keys is not None) as (gone, few):
            parts = self._touched(new, table)
            if not parts:
                log.warning("Empty frame for %s, skipping write", table)
                self._changed(table, new, upsert_keys is not None)
                return 0
            old = self._in_partitions(self.read(table), table, parts)
            # partitions where an incoming key already exists: only these are rewritten
            clash = [tuple(r) for r in old.join(gone, key_cols, "left_semi")
                     .select(*self.partition_cols(table)).distinct().collect()]
            if clash:
                inc = self._in_partitions(new, table, clash)
                kept, moved = self._without(self._in_partitions(old, table, clash), gone, key_cols, few, table)
                with self._setting(*DEALT_JOINS):  # beside few keys, rebalancing keeps a folder's files few
                    self._write(kept.unionByName(inc, allowMissingColumns=True), table, moved or few)
            # rows landing only in partitions without a clash are appended as new files
            if set(parts) - set(clash):
                self._append(self._not_in_partitions(new, table, clash) if clash else new, table)
            self._changed(table, new, upsert_keys is not None)
        return len(parts)

    def _about_to_change(self, table: str) -> None:
        """Called before a sink touches a table."""

    def _changed(self, table: str, batch: DataFrame, upsert: bool) -> None:
        """Called with the stored batch when a sink has replaced or upserted it."""

    def _not_in_partitions(self, df: DataFrame, table: str, parts: list[tuple]) -> DataFrame:
        pcols = self.partition_cols(table)
        types = {c: df.schema[c].dataType for c in pcols}
        key = F.struct(*[F.col(c) for c in pcols])
        lits = [F.struct(*[F.lit(v).cast(types[c]).alias(c) for c, v in zip(pcols, p)])
                for p in parts]
        return df.where(~key.isin(lits))

    def _append(self, out: DataFrame, table: str) -> None:
        """Add rows as new files in their partitions (no existing file is touched)."""
        self._remember_schema(table, out)
        self._save(self._layout_for_write(out, table, moved=False), table, replace=False)
        self._store_layout(table)

    def _layout_for_write(self, out: DataFrame, table: str, moved: bool = True) -> DataFrame:
        """REBALANCE on the partition columns: AQE splits a hot partition value
        over several tasks and merges small ones (no sampling pass); rows are
        sorted by (ticker, date) inside files for row-group skipping. Rows that were
        not ``moved`` since their folders' files were read need no rebalancing."""
        pcols = self.partition_cols(table)
        sort = [c for c in pcols + self._sort_cols(table)]
        return (out.hint("rebalance", *pcols) if moved else out).sortWithinPartitions(*dict.fromkeys(sort))

    def _gathered(self, batch: DataFrame, table: str, clustered: bool) -> DataFrame:
        """A batch to be staged, its rows of a folder in few tasks."""
        return batch if clustered else batch.hint("rebalance", *self.partition_cols(table))

    def _count_partitions(self, table: str) -> int:
        """Leaf partition folders of a table (a directory listing, no job)."""
        depth = len(self.partition_cols(table))
        fs, root = self._fs(self.path(table))
        level = [root]
        for _ in range(depth):
            nxt = []
            for p in level:
                nxt += [st.getPath() for st in fs.listStatus(p)
                        if st.isDirectory() and "=" in st.getPath().getName()]
            level = nxt
        return len(level)

    def write_prices(self, df: DataFrame, ticker: str | None = None, watch: tuple | None = None,
                     clustered: bool = False) -> int:
        """Replace the (ticker, year) slices present in ``df``; returns partitions touched.

        ``clustered`` says that a task of ``df`` holds rows of few buckets, as tasks of a table do that Spark buckets by
        ticker into a multiple of this table's buckets; rows are then written by the tasks that hold them.

        A (ticker, date) repeated within the batch is kept once (the last row of the batch's files, where it is read from files).
        """
        return self._replace(df, "prices", ["ticker", "year"], ticker, watch=watch, clustered=clustered)

    def write_fundamentals(self, df: DataFrame, period: str = "quarterly",
                           ticker: str | None = None, watch: tuple | None = None, clustered: bool = False) -> int:
        """Replace every ticker present in ``df`` (``clustered``: see ``write_prices``).

        A ticker's stored history holds one row per period end: of a repeated one the row of
        the latest fiscal year stays, then a deterministic choice.
        """
        return self._replace(df, period, ["ticker"], ticker, watch=watch, clustered=clustered)

    def write_fundamentals_quarterly(self, df, ticker=None) -> int:
        return self.write_fundamentals(df, "quarterly", ticker)

    def write_fundamentals_annual(self, df, ticker=None) -> int:
        return self.write_fundamentals(df, "annual", ticker)

    def append_prices(self, df: DataFrame, ticker: str | None = None,
                      order_col: str | None = None, clustered: bool = False) -> int:
        """Upsert: stored and new rows, newest source wins per (ticker, date) (``clustered``: see ``write_prices``).

        Within one batch a repeated (ticker, date) keeps the row with the
        highest ``order_col`` (when given), else the last in the batch's files, else a deterministic
        choice (D23: always de-duplicated).
        """
        return self._replace(df, "prices", ["ticker", "year"], ticker,
                             upsert_keys=["ticker", "date"], order_col=order_col, clustered=clustered)

    def write_metadata(self, df: DataFrame, name: str) -> str:
        """Replace a named metadata table.

        A write goes to a folder of its own and counts once it is finished; the one before stays for readers that have
        it open, older ones go. ``df`` may read the table that it replaces.
        """
        path, done = self.metadata_path(name), self._metadata_generations(name)
        df.write.mode("overwrite").parquet(f"{path}/gen={(done[-1] if done else 0) + 1}")
        for old in done[:-1]:
            self._delete(f"{path}/gen={old}")
        return path

    def delete_ticker(self, tickers) -> int:
        """Remove the tickers (a str, a list or a DataFrame with ``ticker``) from
        prices and both fundamentals tables.

        Returns the number of tables that held any of them. A ticker frame is
        applied with semi / anti joins; only its bucket numbers (at most the
        table's) reach the driver.
        """
        tickers = ticker_names(tickers)
        doomed = (tickers.select("ticker").distinct() if isinstance(tickers, DataFrame)
                  else self.spark.createDataFrame([(t,) for t in tickers], "ticker string"))
        affected = 0
        with self._staged(doomed) as gone:
            marked, few = self._if_few(gone)
            for table in TABLES:
                if self._has_files(self.path(table)):
                    affected += self._delete_from(table, marked, few)
        return affected

    def _delete_from(self, table: str, gone: DataFrame, few: bool) -> bool:
        """Rewrite the partitions that hold a ticker of ``gone`` without it."""
        df = self.read(table)
        if self.layout == "bucketed":
            buckets = [r[0] for r in gone.select(self.bucket_of("ticker", self.buckets(table), table)).distinct().collect()]
            df = df.where(F.col("ticker_bucket").isin(buckets))
        pcols = self.partition_cols(table)
        held = [tuple(r) for r in df.select(*dict.fromkeys(["ticker", *pcols]))
                .join(gone.withColumn("_hit", F.lit(True)), "ticker", "left").groupBy(*pcols)
                .agg(F.count("_hit").alias("hit"), F.count(F.lit(1)).alias("n")).where("hit > 0").collect()]
        if not held:
            return False
        emptied = [p[:-2] for p in held if p[-2] == p[-1]]
        if len(emptied) < len(held):
            kept, moved = self._without(self._in_partitions(df, table, [p[:-2] for p in held]), gone, ["ticker"], few, table)
            with self._setting(*DEALT_JOINS):
                self._write(kept, table, moved)
        self._frames.pop(table, None)
        for p in emptied:
            self._drop_partition(table, p)
        return True

    def _drop_partition(self, table: str, values: tuple) -> None:
        """Remove a partition folder and the parents that it leaves empty."""
        sub = [f"{c}={v}" for c, v in zip(self.partition_cols(table), values, strict=True)]
        self._delete(f"{self.path(table)}/{'/'.join(sub)}")
        for k in range(len(sub) - 1, 0, -1):
            self._delete_if_empty(f"{self.path(table)}/{'/'.join(sub[:k])}")

    def _delete_if_empty(self, path: str) -> None:
        fs, p = self._fs(path)
        if fs.exists(p) and len(fs.listStatus(p)) == 0:
            fs.delete(p, False)

    def list_tickers(self, table: str = "prices") -> DataFrame:
        return (self.read(table).select("ticker").where(F.col("ticker").isNotNull())
                .distinct().orderBy("ticker"))


__all__ = ["Store", "TABLES", "TICKER_BUCKETS"]
