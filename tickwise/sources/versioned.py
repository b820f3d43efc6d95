"""Tables whose state is a list of files, committed for all tables at once.

``VersionedStore`` is a ``Store`` whose sinks never touch a file that a reader may be reading. New rows, and the rows that stay
of files that hold a replaced key, go to a folder of their own (``gen=<id>``); the commit then writes one small file,
``_commits/<version>.json``, that lists the live files of every table. So

* a correction rewrites the files that hold its keys, not their whole (year, bucket) folders. They are found by a
  scan of the key columns of the touched folders, where Parquet's Bloom filters on the ticker (its dictionaries,
  where a file's tickers fit one) and row-group statistics skip the files that cannot hold it, and ``_metadata.file_path`` names those that do;
* writes inside ``with store.transaction():`` become visible together. A job that dies before the commit leaves files that
  no version lists, which ``vacuum`` removes;
* a reader keeps the version it opened until ``refresh``, and ``version=`` opens an earlier one.

A version number is taken by renaming a finished file into place; of two writers that started from one version the second
fails with ``CommitConflict`` and may try again. What the driver holds are file names. Rows move in Spark jobs only: a staged batch, a key
semi join, and a rewrite of the files concerned, whose joins read stored tables that Spark can split.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.operators.ratios import ticker_names
from tickwise.sources.store import DEALT_JOINS, TABLES, Store

FEW = 10  # tickers that are pushed into the scan by name, as many as Parquet filters take


class CommitConflict(RuntimeError):
    """Another writer committed the version that this one was about to."""


class VersionedStore(Store):
    """A root folder of tickwise tables with one commit log; ``version`` opens an earlier state (read only)."""

    def __init__(self, *args, version: int | None = None, **kwargs):
        super().__init__(*args, **kwargs)
        if self.layout != "bucketed":
            raise ValueError("versioned tables have the bucketed layout")
        self.pinned = version
        self._open: dict[str, list[str]] | None = None   # files of the version being read
        self._pending: dict[str, list[str]] | None = None  # of the transaction under way
        self.version = 0
        self.last_commit: dict[str, dict[str, int]] = {}   # table -> files added and removed

    # ------------------------------------------------------------------ versions
    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/_commits")
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _files(self, version: int) -> dict[str, list[str]]:
        fs, p = self._fs(f"{self.root}/_commits/{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _live(self, table: str) -> list[str]:
        """Live files of a table, relative to its folder."""
        if self._pending is not None:
            return self._pending.get(table, [])
        if self._open is None:
            known = self.versions()
            self.version = self.pinned if self.pinned is not None else (known[-1] if known else 0)
            self._open = self._files(self.version) if self.version else {}
        return self._open.get(table, [])

    def refresh(self) -> None:
        super().refresh()
        if self._pending is None:
            self._open = None

    @contextmanager
    def transaction(self):
        """Writes inside become visible together, at the end; an error inside leaves everything as it was."""
        if self._pending is not None:  # inside another one
            yield
            return
        if self.pinned is not None:
            raise ValueError("an earlier version is read only")
        before = {t: list(self._live(t)) for t in TABLES}
        self._pending = {t: list(f) for t, f in before.items()}
        try:
            yield
            after = self._pending
            if after != before:
                self._commit(after)
                self.last_commit = {t: {"added": len(set(after[t]) - set(before[t])), "removed": len(set(before[t]) - set(after[t]))}
                                    for t in TABLES}
        finally:
            self._pending = None
            self.refresh()

    def _commit(self, files: dict[str, list[str]]) -> None:
        fs, final = self._fs(f"{self.root}/_commits/{self.version + 1}.json")
        _, draft = self._fs(f"{self.root}/_commits/.{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(files), "utf-8"))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise CommitConflict(f"version {self.version + 1} was committed by another writer")

    def vacuum(self, keep: int = 1) -> int:
        """Remove commits but the newest ``keep`` and the files that none of those lists; returns files removed."""
        known = self.versions()
        used = {t: set() for t in TABLES}
        for v in known[-keep:]:
            for t, files in self._files(v).items():
                used[t] |= set(files)
        removed = 0
        for t in TABLES:
            fs, p = self._fs(self.path(t))
            if not fs.exists(p):
                continue
            found = fs.listFiles(p, True)
            base = fs.makeQualified(p).toString()
            while found.hasNext():
                at = found.next().getPath()
                name = at.toString()[len(base) + 1:]
                if name.startswith("gen=") and name not in used[t]:
                    fs.delete(at, False)
                    removed += name.endswith(".parquet")
        for v in known[:-keep]:
            self._delete(f"{self.root}/_commits/{v}.json")
        return removed

    # ------------------------------------------------------------------ reading
    def _has_files(self, path: str) -> bool:
        for t in TABLES:
            if path == self.path(t):
                return bool(self._live(t))
        return super()._has_files(path)

    def _frame(self, table: str, files: list[str]) -> DataFrame:
        """The rows of some files of a table, with partition columns."""
        schema = T.StructType([*self._schemas[table].fields, T.StructField("gen", T.StringType())])
        return (self.spark.read.schema(schema).option("basePath", self.path(table))
                .parquet(*[f"{self.path(table)}/{f}" for f in files]))

    def _raw(self, table: str) -> DataFrame:
        return self._frame(table, self._live(table)).drop("gen")

    # ------------------------------------------------------------------ writing
    def _add(self, out: DataFrame, table: str, moved: bool) -> list[str]:
        """Write rows as a generation of their own; returns its files."""
        self._remember_schema(table, out)
        gen = f"gen={uuid.uuid4().hex[:16]}"
        (self._layout_for_write(out, table, moved).write.option("parquet.bloom.filter.enabled#ticker", "true").option("compression", "zstd")
         .partitionBy(*self.partition_cols(table)).parquet(f"{self.path(table)}/{gen}"))
        self._store_layout(table)
        fs, p = self._fs(f"{self.path(table)}/{gen}")
        base, out_files, found = fs.makeQualified(p).toString(), [], fs.listFiles(p, True)
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.endswith(".parquet"):
                out_files.append(f"{gen}/{name[len(base) + 1:]}")
        return sorted(out_files)

    def _holding(self, table: str, parts: list[tuple], gone: DataFrame, keys: list[str]) -> list[str]:
        """Live files that hold a key of ``gone``."""
        old = self._in_partitions(self._frame(table, self._live(table)), table, parts)
        if "ticker" in keys:
            names = [r[0] for r in gone.select("ticker").distinct().limit(FEW + 1).collect()]
            if len(names) <= FEW:  # reaches the Bloom filters
                old = old.where(F.col("ticker").isin(names))
        hit = (old.select(*keys, F.col("_metadata.file_path").alias("_file")).join(gone, keys, "left_semi")
               .select("_file").distinct().collect())  # file names
        return [r[0][r[0].index("/gen=") + 1:] for r in hit]

    def _swap(self, table: str, files: list[str], rows: DataFrame, moved: bool = False) -> None:
        """In the transaction: ``files`` go, ``rows`` come (``moved`` as in ``_layout_for_write``)."""
        with self._setting(*DEALT_JOINS):
            added = self._add(rows, table, moved)
        self._pending[table] = sorted((set(self._pending[table]) - set(files)) | set(added))
        self._frames.pop(table, None)

    def _replace(self, df: DataFrame, table: str, keys: list[str], ticker: str | None,
                 upsert_keys: list[str] | None = None, order_col: str | None = None, watch: tuple | None = None,
                 clustered: bool = False) -> int:
        key_cols = upsert_keys or keys
        batch = self._batch(df, table, ticker, order_col, watch)
        with self.transaction(), self._staged(self._gathered(batch, table, clustered)) as new:
            parts = self._touched(new, table)
            if not parts:
                return 0
            files, rows, moved = [], new, False
            if self._live(table):
                self.read(table)  # its columns are known then
                with self._keys_of(new, key_cols, upsert_keys is not None) as (gone, few):
                    files = self._holding(table, parts, gone, key_cols)
                    if files:
                        stay, moved = self._without(self._frame(table, files).drop("gen"), gone, key_cols, few, table)
                        rows = stay.unionByName(new, allowMissingColumns=True)
                    self._swap(table, files, rows, moved or bool(files) and few)
            else:
                self._swap(table, files, rows)
            return len(parts)

    def delete_ticker(self, tickers) -> int:
        tickers = ticker_names(tickers)
        doomed = (tickers.select("ticker").distinct() if isinstance(tickers, DataFrame)
                  else self.spark.createDataFrame([(t,) for t in tickers], "ticker string"))
        affected = 0
        with self.transaction(), self._staged(doomed) as staged:
            gone, few = self._if_few(staged)
            for table in TABLES:
                if not self._live(table):
                    continue
                self.read(table)
                buckets = gone.select(self.bucket_of("ticker", self.buckets(table), table).alias("ticker_bucket")).distinct()
                found = self._frame(table, self._live(table)).join(buckets, "ticker_bucket", "left_semi")
                parts = self._touched(found, table)
                files = self._holding(table, parts, gone, ["ticker"]) if parts else []
                if files:
                    affected += 1
                    self._swap(table, files, *self._without(self._frame(table, files).drop("gen"), gone, ["ticker"], few, table))
        return affected
