"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.session import ensure_checkpoint_dir, shared_dir

WORDS = 1 << 20  # 64-bit words of a membership bitmap: 8 MB, whatever the input


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): other columns are dropped, a null text is the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` read back from the shared checkpoint folder (lineage ends there)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of a few rows: what a function holds at a time follows these, not the batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared checkpoint folder (smaller than a checkpoint)."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """One-hash Bloom filter of the hashed longs in the only column, of fixed size.

    A filter only saves moving rows that cannot matter: what passes by accident meets an exact
    join later. The more values, the more passes; nothing is ever lost.
    """
    v = F.col(hashes.columns[0])
    words = (hashes.select(F.shiftrightunsigned(v, 6).bitwiseAND(F.lit(WORDS - 1)).alias("word"),
                           F.expr(f"shiftleft(1L, cast(`{hashes.columns[0]}` & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # WORDS rows at most
    out = np.zeros(WORDS, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def in_bitmap(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    return (filled[(h >> np.uint64(6)) & np.uint64(WORDS - 1)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(node, root)`` with the smallest node as root.

    Alternating large-star / small-star rounds; every node that has an edge to another node and
    is not itself a root gets one row. Both inputs of each join are stored tables, so Spark can
    split a node that a large part of the edges meets. Null ends and self loops are ignored.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .where("u is not null and v is not null and u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").where("v <> m")
                    .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        edges = cut(large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                    .union(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
