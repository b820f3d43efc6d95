"""Merkle fixity audit of WARC archives.

A page becomes a WARC/1.0 response record; the records of one archive file, in order, get their byte
offsets. The leaves of a file's tree are hashes of record digest, offset and length; an inner node
hashes the hashes of its ``fanout`` ordered children, which cover one range of offsets. Two replicas are
compared at their roots, and only children of nodes that differ are looked at on the way down, so an
intact file costs one comparison and a damaged record a path.

All steps are joins and groupings of bounded groups (``fanout`` children); texts are hashed where they
are read and never shuffled. The only windows run over the records of one archive file, which
``file`` must keep to a bounded number (``file_of`` does for any ids).

Defined cases: null urls and bodies are empty; records of one file are ordered by id (nulls first), then
digest; records of a null ``file`` are a file of their own; an empty table has no files and an empty audit; repeated rows are records of their own; columns beside id, url
and body are ignored, whatever their names; a body of any length is hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import cut


def record(url: Column, body: Column) -> Column:
    """The text of a WARC/1.0 response record."""
    url, body = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(body.cast("string"), F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def file_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", per_file: int = 1000) -> Column:
    """Deals pages to as many files as keep them at about ``per_file`` records."""
    files = max(1, -(-pages.count() // per_file))
    return F.pmod(F.xxhash64(F.col(id_col), F.col(url_col)), F.lit(files))


def layout(pages: DataFrame, file: Column, id_col: str = "page_id", url_col: str = "url",
           body_col: str = "html") -> DataFrame:
    """(file, seq, id, offset, length, digest) of the records of an archive."""
    rows = pages.select(F.col(id_col).alias("id"), file.cast("long").alias("file"),
                        record(F.col(url_col), F.col(body_col)).alias("record"))
    rows = rows.select("file", "id", F.octet_length("record").cast("long").alias("length"),
                       F.sha2("record", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("id", "digest")
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("seq"), "id",
                       (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0))
                        - F.col("length")).alias("offset"), "length", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0 of the trees: (level, file, node, lo, hi, hash)."""
    return records.select(
        F.lit(0).alias("level"), "file", F.col("seq").alias("node"), F.col("offset").alias("lo"),
        (F.col("offset") + F.col("length")).alias("hi"),
        F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)
        .alias("hash"))


def above(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level up: each node hashes up to ``fanout`` ordered children."""
    children = F.array_sort(F.collect_list(F.struct("node", "hash")))
    return (nodes.groupBy((F.col("level") + 1).alias("level"), "file", F.expr(f"node div {fanout}").alias("parent"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), children.alias("c"))
            .select("level", "file", F.col("parent").alias("node"), "lo", "hi",
                    F.sha2(F.array_join(F.col("c.hash"), ""), 256).alias("hash")))


def trees(records: DataFrame, fanout: int = 16, height: int | None = None) -> list[DataFrame]:
    """The levels of the Merkle trees of all files, leaves first; every file has the same height."""
    if height is None:
        height = _height(records.agg(F.max("seq")).first()[0], fanout)
    levels = [cut(leaves(records))]
    for _ in range(height):
        levels.append(cut(above(levels[-1], fanout)))
    return levels


def _height(last: int | None, fanout: int) -> int:
    height = 0
    while (last or 0) >= fanout ** height:
        height += 1
    return height


def _join(left: DataFrame, right: DataFrame, at: str, how: str) -> DataFrame:
    """``left`` joined to ``right`` on the file, null or not, and ``at``; the right side's two keys are dropped."""
    keys = {k: f"right_{k}" for k in ("file", at)}
    joined = left.join(right.withColumnsRenamed(keys), F.expr(f"file <=> right_file and {at} = right_{at}"), how)
    return joined.drop(*keys.values())


def mismatches(a: list[DataFrame], b: list[DataFrame], fanout: int = 16) -> DataFrame:
    """(file, node): leaves that differ, or that one replica lacks; whole equal branches are never opened."""
    frontier = None
    for mine, other in zip(reversed(a), reversed(b), strict=True):
        if frontier is not None:
            opened = frontier.withColumnRenamed("node", "parent")
            mine, other = (
                _join(x.withColumn("parent", F.expr(f"node div {fanout}")), opened, "parent", "left_semi")
                for x in (mine, other))
        m, o = (x.select(F.col("file").alias(f"{h}_file"), F.col("node").alias(f"{h}_node"), F.col("hash").alias(h))
                for x, h in ((mine, "mine"), (other, "other")))
        frontier = cut(m.join(o, F.expr("mine_file <=> other_file and mine_node = other_node"), "full")
                       .where("not (mine <=> other)").select(F.coalesce("mine_file", "other_file").alias("file"),
                                                             F.coalesce("mine_node", "other_node").alias("node")))
    return frontier


def audit(primary: DataFrame, replica: DataFrame, fanout: int = 16) -> DataFrame:
    """(file, seq, id, offset, length, digest, status): a row for each record of the primary's layout,
    and for each of the replica's that the primary lacks.

    ``intact``: the trees agree on it. Otherwise, by id within the file: ``moved`` (same bytes at another
    place), ``corrupt`` (other bytes), ``missing`` (only in the primary), ``extra`` (only in the replica).
    """
    primary, replica = cut(primary), cut(replica)
    tops = [x.agg(F.max("seq")).first()[0] for x in (primary, replica)]
    height = _height(max((t for t in tops if t is not None), default=0), fanout)
    bad = mismatches(trees(primary, fanout, height), trees(replica, fanout, height), fanout)
    spots = bad.select(F.col("file"), F.col("node").alias("seq"))
    mine = _join(primary, spots, "seq", "left_semi")
    other = cut(_join(replica, spots, "seq", "left_semi"))
    there = other.groupBy("file", F.col("id").alias("other_id")).agg(F.collect_set("digest").alias("digests"))
    status = (F.when(F.col("digests").isNull(), "missing")
              .when(F.array_contains("digests", F.col("digest")), "moved").otherwise("corrupt"))
    judged = (mine.alias("m").join(there.withColumnRenamed("file", "f"), F.expr("file <=> f and id <=> other_id"), "left")
              .select("file", "seq", status.alias("found")))
    ids = mine.select(F.col("file").alias("f"), F.col("id").alias("other_id")).distinct()
    extra = other.join(ids, F.expr("file <=> f and id <=> other_id"), "left_anti")
    shown = ["file", "seq", "id", "offset", "length", "digest"]
    return (_join(primary, cut(judged), "seq", "left")
            .select(*shown, F.coalesce("found", F.lit("intact")).alias("status"))
            .union(extra.select(*shown, F.lit("extra").alias("status"))))
