"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. Source i has weight w_i and size s_i (words); it may be read at most ``epochs`` times. All sources share
``share`` of all words by weight; a source that would get more than ``epochs * s_i`` is clamped there, and what it leaves goes
to the others by weight, again and again until none is above. Between rounds only two sums move: the words
left and the weights left, whose quotient is the level of the unclamped (target = weight * level). Everything
is an integer or a quotient of two, so reruns agree to the last bit.

Sample. A target of r epochs takes every document floor(r) times, whole; the rest of the target, less than one
epoch, takes some documents once more. Documents stand in a seeded order, that of a SHA-256 of seed, id and text: as many
are taken from its beginning as stay within the rest. What then is still open (less than the document that did not fit) is
filled by the same rule from untaken documents no longer than it, ``fills`` times. So a source ends at most the length
of one short document under its target and never over it.

How the beginning is found without sorting a source: documents fall into ``BUCKETS`` ranges of the order. Bucket
sums per source (pre-aggregated in every task) tell in which bucket the cut lies; only the documents of that one
bucket are put in order. A hot source costs a sort of 1/4096 of it; its rows meet the per-source figures in a join
of two stored tables, which Spark can split.

Defined cases: a null text, or one without words, has size 0 and is taken 0 words; a null source is a source of
its own, after all others; sources are ordered by code point; a null id takes part like any other; rows that repeat id
and text share their place in the order and are taken alike; a source without words has the target 0; an empty table gives
an empty one; other columns, whatever their names, are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import stored
from tickwise.operators.metrics import global_row_number

BUCKETS = 4096  # ranges of the seeded order: three hexadecimal digits
WORD = "[^ \\x09-\\x0D]+"


def sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size, place): words of each row and its place in the seeded order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                       F.sha2(F.concat_ws(":", F.lit(str(seed)), doc, text), 256).alias("place"))


def source_table(rows: DataFrame, weights: list[int]) -> DataFrame:
    """(n, source, weight, source_size): sources numbered by code point from 0, null last, weights in turn."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = global_row_number(sums, [F.col("source").asc_nulls_last()], "n").withColumn("n", F.col("n") - 1)
    turn = F.array(*map(F.lit, weights))[(F.col("n") % len(weights)).cast("int")]
    return numbered.select("n", "source", turn.cast("long").alias("weight"), "source_size")


def fill(sources: DataFrame, share_percent: int, epochs: int) -> tuple[int, int]:
    """The level of unclamped sources as (words, weights), of which it is the quotient.

    Each round is one aggregate over the source table; it ends when no further source is clamped.
    """
    s = F.col("source_size").cast("decimal(38,0)")
    total = int(sources.agg(F.sum(s)).first()[0] or 0) * share_percent  # in hundredths of a word
    weight = int(sources.agg(F.sum("weight")).first()[0] or 0)
    words, weights, clamped = total, weight, 0
    while weights:
        above = F.expr(f"cast(weight as decimal(38,0)) * {words} >= cast(source_size as decimal(38,0)) * {100 * epochs * weights}")
        n, size, gone = sources.where(above).agg(F.count("*"), F.sum(s), F.sum("weight")).first()
        if n == clamped:
            return words, weights
        clamped, words, weights = n, total - 100 * epochs * int(size), weight - gone
    return 0, 0


def targets(sources: DataFrame, share_percent: int, epochs: int) -> DataFrame:
    """``sources`` with target (words), whole (epochs) and rest (words of the last, partial epoch)."""
    words, weights = fill(sources, share_percent, epochs)
    exact = "cast(weight as decimal(38,0)) * {w}".format(w=words)
    clamped = f"({exact} >= cast(source_size as decimal(38,0)) * {100 * epochs * weights})" if weights else "true"
    found = sources.selectExpr(
        "*", f"{clamped} as clamped", f"cast(({exact}) div {100 * max(weights, 1)} as long) as floor",
        f"cast({exact} as double) / {100 * max(weights, 1)}D as level")
    return found.selectExpr(
        "n", "source", "weight", "source_size",
        f"case when clamped then cast({epochs} * source_size as double) else level end as target",
        f"case when clamped then {epochs}L else floor div source_size end as whole",
        "case when clamped then 0L else floor % source_size end as rest")


def beginning(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n, upto, words): of ``rows(n, place, size)`` in order of place, as many as stay within ``wanted(n, rest)``.

    ``upto`` is the place of the last one taken; sources of which nothing is taken have no row.
    """
    bucket = F.substring("place", 1, 3)
    by_n = Window.partitionBy("n")
    ordered = by_n.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("n", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.max("place").alias("upto"))
    filled = (sums.join(wanted.select("n", "rest"), "n")  # at most BUCKETS rows per source
              .withColumn("sum", F.sum("words").over(ordered)))
    whole = (filled.where("sum <= rest").groupBy("n").agg(F.max("upto").alias("upto"), F.max("sum").alias("words")))
    cut = (filled.where("sum > rest").groupBy("n").agg(F.min(F.struct("bucket", (F.col("sum") - F.col("words"))
                                                                      .alias("before"), "rest")).alias("c"))
           .select("n", "c.*"))
    inner = (rows.withColumn("bucket", bucket).join(stored(cut, "cuts"), ["n", "bucket"])
             .groupBy("n", "place", "before", "rest").agg(F.sum("size").alias("size"))
             .withColumn("sum", F.col("before") + F.sum("size").over(by_n.orderBy("place").rowsBetween(
                 Window.unboundedPreceding, 0)))
             .where("sum <= rest").groupBy("n").agg(F.max("place").alias("upto"), F.max("sum").alias("words")))
    return whole.unionByName(inner).groupBy("n").agg(F.max("upto").alias("upto"), F.max("words").alias("words"))


def mix(docs: DataFrame, weights: list[int], share_percent: int = 150, epochs: int = 2, fills: int = 2, seed: int = 1,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken) of each row; ``taken`` = size * repeats."""
    if not weights or min(weights) < 1 or epochs < 1 or share_percent < 0:
        raise ValueError("weights and epochs are positive, the share is not negative")
    rows = stored(sized(docs, seed, id_col, text_col, source_col), "mix-rows")
    plan = stored(targets(source_table(rows, weights), share_percent, epochs), "mix-targets")
    known = stored(rows.join(plan.select("n", "source"), rows.source.eqNullSafe(plan.source)).drop("source"), "mix-numbered")
    left, steps = plan.select("n", "rest"), []
    open_rows = known
    for _ in range(1 + fills):
        step = stored(beginning(open_rows, left).join(left, "n", "right")
                      .selectExpr("n", "rest as most", "coalesce(upto, '') as upto",
                                  "rest - coalesce(words, 0) as rest"), "mix-step")
        steps.append(step.drop("rest"))
        left = step.select("n", "rest")
        # untaken rows that fit into what is left; those without words stay out of the order
        open_rows = (open_rows.join(step, "n")
                     .where("place > upto and size <= rest and size > 0").select(*known.columns))
    taken = plan.drop("rest")
    for i, step in enumerate(steps):
        taken = taken.join(step.select("n", F.col("most").alias(f"most{i}"), F.col("upto").alias(f"upto{i}")), "n")
    # a row is open in a step if it was not taken before and fits what is left; the first step takes any row
    more = " or ".join(f"(place <= upto{i}" + (f" and size <= most{i} and size > 0)" if i else ")") for i in range(len(steps)))
    per = stored(taken, "mix-per-source")
    return known.join(per, "n").selectExpr(
        "doc_id", "source", "size", "source_size", "target", f"whole + int({more}) as repeats",
        f"size * (whole + int({more})) as taken")
