"""SimHash near-duplicates through an inverted index on the bytes of the fingerprint.

A fingerprint has eight positional bytes. Fingerprints that differ in at most ``max_bits`` bits
share at least ``8 - max_bits`` of them; that is the count filter's guaranteed minimum. A posting
list per single (position, byte) would hold 1/256 of all fingerprints and so emit a number of
pairs that grows with the square of the input, so the lists are kept for *sets* of positions:
eight positions are cut into ``max_bits + 2`` runs, and a list is keyed by the bytes of two whole
runs. ``max_bits`` differing bytes leave at least two runs untouched, so no pair is missed. For
the pairs of a list the shared positional bytes are tallied, pairs below the guaranteed minimum go,
and the rest are verified bit by bit.

Lists longer than ``long_list`` (near copies in thousands) are not paired at all. Their
fingerprints are listed under every one-bit change of themselves; two of them share such a centre
exactly if they differ in at most two bits, and a centre has at most 65 members. For ``max_bits``
above two the centres are those of ``max_bits // 2`` changes, rounded up, and links are verified.

Defined cases: a null text is empty; an empty text has fingerprint zero and links like any other;
a text of fewer words than the shingle length is one shingle; repeated rows get a row each;
a null ``doc_id`` keeps its row and never names a component, unless all its members are null; columns
beside id and text are ignored, whatever their names, and kept by ``keep_one``; a text of any length is read whole.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import components, cut, id_and_text

BLOCK = 1 << 16  # shingles whose bits are counted at a time


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of one text: a bit is set if over half the hashes set it."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n, votes = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(starts[at:min(n, at + BLOCK)].tolist(), ends[at + k - 1:at + BLOCK + k - 1].tolist(), strict=False)
        digests = b"".join([xxhash.xxh64_digest(line[s:e], seed) for s, e in spans])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, fp): the SimHash of each row's whole text as a signed long; mark: the text's XXH64."""
    def run(batches):
        for b in batches:
            fps = [simhash(t, shingle, seed) for t in b.column(1).to_pylist()]
            fps = np.array(fps, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], names=["doc_id", "mark", "fp"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"),
                                                      F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def _runs(max_bits: int) -> list[int]:
    """Byte masks of the runs that the eight positions are cut into."""
    if not 0 <= max_bits <= 6:
        raise ValueError("max_bits must lie between 0 and 6")
    cuts = [round(i * 8 / (max_bits + 2)) for i in range(max_bits + 3)]
    return [sum(0xFF << 8 * p for p in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, max_bits: int = 2, long_list: int = 128) -> DataFrame:
    """(a, b): links between the distinct values of ``fps(fp)`` that join the same components as
    all pairs within ``max_bits`` bits do; every emitted link is within ``max_bits``.
    """
    nodes = fps.select("fp").where("fp is not null").distinct()
    masks = [_signed(x | y) for x, y in combinations(_runs(max_bits), 2)]
    lists = cut(nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                             .alias("positions", "bytes")))
    sizes = cut(lists.groupBy("positions", "bytes").agg(F.count("*").alias("n")).where("n > 1"))
    short = lists.join(sizes.where(F.col("n") <= long_list), ["positions", "bytes"]).drop("n")
    x = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum((F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for p in range(8))
    pairs = (short.withColumnRenamed("fp", "a").join(short.withColumnRenamed("fp", "b"), ["positions", "bytes"])
             .where("a < b").where(tally >= 8 - max_bits).where(F.bit_count(x) <= max_bits).select("a", "b"))

    centres = (lists.join(sizes.where(F.col("n") > long_list), ["positions", "bytes"])
               .select("fp", F.col("fp").alias("centre")).distinct())
    near = F.array(F.col("centre"), *[F.col("centre").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)])
    for _ in range((max_bits + 1) // 2):
        centres = centres.select("fp", F.explode(near).alias("centre")).distinct()
    if max_bits:
        groups = centres.groupBy("centre").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where("size(fps) > 1")
        if max_bits % 2:  # members of one centre may differ in one bit more than max_bits
            all_pairs = (groups.select(F.posexplode("fps").alias("i", "a"), "fps")
                         .select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b")))
            dense = all_pairs.where(F.bit_count(x) <= max_bits)
        else:
            dense = groups.select(F.col("fps")[0].alias("a"), F.explode("fps").alias("b")).where("a <> b")
        pairs = pairs.union(dense)
    return pairs.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", long_list: int = 128) -> DataFrame:
    """(doc_id, mark, fp, root, component_id): the smallest doc_id that links of ``max_bits`` or fewer reach.

    ``root`` names the component by a fingerprint; ``mark`` is the XXH64 of the text.
    """
    rows = cut(fingerprints(docs, shingle, seed, id_col, text_col))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, max_bits, long_list))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = cut(rooted.join(named, "root").select("fp", "root", "component_id"))
    return rows.join(names, "fp").select("doc_id", "mark", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, all columns, with one of each component.

    The one of the smallest id stays (a null id last, then the smallest XXH64 of the text).
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("key_id"),
                   F.col("mark").alias("key_mark"))
    kept = near_duplicates(docs, shingle, max_bits).groupBy("root").agg(F.min(key).alias("k")).select("k.*")
    # the columns travel in one struct, so none of them can clash with the keys
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("none"),
                         F.coalesce("doc_id", F.lit(0)).alias("key_id"),
                         F.xxhash64(F.coalesce("text", F.lit(""))).alias("key_mark"))
    keys = ["none", "key_id", "key_mark"]
    return marked.join(cut(kept), keys, "left_semi").dropDuplicates(keys).select("row.*")
