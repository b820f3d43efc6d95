"""Document fingerprints: SimHash of weighted terms, and search in permuted block tables.

DataFrame functions only. Terms are the lower-cased words of a text; a term's weight is its length
less one, at most ``MAX_WEIGHT``: frequent words are short, so they weigh little or nothing
without a pass over the corpus. Each occurrence adds its weight to the set bits of its
XXH64 and takes it from the others; the fingerprint holds the bits whose sum is positive.

Two bits share one running sum of a long (bit ``j`` in the low and bit ``j + 32`` in the high half).
A text of less than 2 GiB, the most a Spark string holds, cannot overflow a half.

Defined cases: a null text is empty; a text without a weighted term has fingerprint zero;
repeated rows get a row each; a null ``doc_id`` is kept (and sorts as the smallest id);
columns beside id and text are dropped, whatever their names; a text of any length is read whole. The votes of a key fit their lanes
while its rows times their words times 8 stay below 2**32: a 5 MB text may be repeated some hundred times.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import cut, id_and_text

MAX_WEIGHT = 8
HALVES = (1 << 32) | 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def term_votes(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``keys`` with ``fp``: one row per distinct key, the SimHash of its text.

    ``keys`` must determine the text. Rows that repeat a key add the same votes again, which
    leaves every sign as it is.
    """
    words = F.split(F.translate(F.lower(F.col(text_col)), "\t\n\u000b\f\r", "     "), " ")
    terms = (rows.select(*keys, F.explode(words).alias("term"))
             .select(*keys, F.xxhash64("term").alias("h"),
                     F.greatest(F.least(F.length("term") - 1, F.lit(MAX_WEIGHT)), F.lit(0)).cast("long").alias("w")))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(HALVES)) * F.col("w")).alias(f"v{j}")
             for j in range(32)]
    votes = terms.groupBy(*keys).agg(*lanes, F.sum("w").alias("total"))

    def bit(j: int) -> Column:
        half = (F.col(f"v{j}").bitwiseAND(F.lit((1 << 32) - 1)) if j < 32
                else F.shiftrightunsigned(f"v{j - 32}", 32))
        return F.when(half * 2 > F.col("total"), F.lit(_signed(1 << j))).otherwise(F.lit(0))

    fp = bit(0)
    for j in range(1, 64):
        fp = fp.bitwiseOR(bit(j))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits of two fingerprints, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each distinct (doc_id, text)."""
    rows = id_and_text(docs, id_col, text_col).withColumn("sha", F.sha2("text", 256))
    return term_votes(rows, ["doc_id", "sha"], "text").select("doc_id", "fp")


def within(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(query, fp): every distinct value of ``fps(fp)`` within ``radius`` bits of each ``queries(fp)``.

    The 64 bits are cut into ``radius + 2`` blocks (or ``blocks``); a table per choice of
    ``blocks - radius`` of them holds each fingerprint under those blocks' bits, permuted to the
    front as its key. ``radius`` differing bits leave at least one choice untouched, so the
    tables miss nothing. A pair that meets in several tables is kept in the first only.
    """
    n = blocks or radius + 2
    if n <= radius:
        raise ValueError("more blocks than the radius are needed")
    edges = [i * 64 // n for i in range(n + 1)]
    parts = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:], strict=False)]
    masks = [_signed(sum(c)) for c in combinations(parts, n - radius)]
    keyed = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("tab", "key")
    index = fps.select("fp").distinct().select("fp", keyed)
    asked = queries.select("fp").distinct().select(F.col("fp").alias("query"),
                                                   *[F.col("fp").alias("fp")]).select("query", keyed)
    x = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return (asked.join(index, ["tab", "key"]).where(F.bit_count(x) <= radius).where(first == F.col("tab"))
            .select("query", "fp"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) for distinct ``ids(id)``: the next smaller id, the largest after the smallest.

    Ids are dealt to ranges; each range looks back inside itself, and its smallest id takes the
    largest one of the nearest lower range. Only the ranges' ends, a row each, meet in one task.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(ids.distinct().repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("before", F.lag("id").over(Window.partitionBy("part").orderBy("id")))
    tops = ranged.groupBy("part").agg(F.max("id").alias("top"))
    ends = tops.select("part", F.coalesce(F.lag("top").over(Window.orderBy("part")),
                                          F.max("top").over(Window.partitionBy())).alias("below"))
    return (inside.join(F.broadcast(ends), "part")  # a row per range
            .select("id", F.coalesce("before", "below").alias("next_id")))


def edited_against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its latter half replaced, and of the next document.

    The last ``floor(n_chars / 2)`` code points are replaced by the first as many (or all) of the
    next document, descending id; the first follows the last. Where rows share an id, the next
    document is the one with the smallest XXH64 under the next smaller id. Result:
    (doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp), a row for each input row.
    """
    none = -(1 << 63)  # stands for a null id in keys
    rows = id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(none)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    heads = cut(rows.select("id", "mark", F.length("text").cast("long").alias("n_chars")))
    donors = heads.groupBy("id").agg(F.min("mark").alias("mark"))
    follow = cut(next_ids(heads.select("id")).join(
        donors.select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark")), "next_id"))
    wanted = heads.distinct().join(follow, "id").select(
        F.col("id").alias("for_id"), F.col("mark").alias("for_mark"), F.expr("n_chars div 2").cast("int").alias("k"),
        F.col("next_id").alias("id"), F.col("next_mark").alias("mark"))
    tails = (rows.join(wanted, ["id", "mark"])
             .select("for_id", "for_mark", F.expr("left(text, k)").alias("tail"))
             .dropDuplicates(["for_id", "for_mark"])
             .select(F.col("for_id").alias("id"), F.col("for_mark").alias("mark"), "tail"))
    both = (rows.join(tails, ["id", "mark"])
            .withColumn("edited", F.concat(F.expr("left(text, length(text) - length(text) div 2)"), "tail"))
            .select("id", "mark", F.sha2("edited", 256).alias("edited_sha256"),
                    F.posexplode(F.array("text", "edited")).alias("side", "t")))
    votes = term_votes(both, ["id", "mark", "edited_sha256", "side"], "t")  # a key holds what the join dealt by
    known = cut(votes.groupBy("id", "mark", "edited_sha256").agg(
        F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp")))
    nexts = follow.join(known.select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"),
                                     F.col("fp").alias("next_fp")), ["next_id", "next_mark"]).select("id", "next_fp")
    return heads.join(known, ["id", "mark"]).join(nexts, "id").select(
        F.when(F.col("id") != none, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
        "fp", "edited_fp", "next_fp")
