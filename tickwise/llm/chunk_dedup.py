"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text (32 bytes wide); a chunk ends where the hash is small, once it
has ``least`` bytes, or at ``most`` bytes. Ends depend on nearby bytes only, so an insertion changes the
chunks around it and leaves those behind it as they were. Chunks are compared by a 128-bit digest.

A run of neighbouring chunks that all occur elsewhere too, of ``run`` bytes or more, is a repeat, and so is a
run that is a whole text, whatever its length. ``run`` is the least size of a chunk unless a caller asks
for longer runs, so only the short last chunk of a text can occur twice without being a repeat, where the chunk before
it does not. Of each chunk in a repeat, every occurrence but the corpus's first (by id, then place) is removed.

Only chunks whose digest may occur twice are moved; a bitmap of fixed size tells which, and an exact
join follows. No group is gathered: first occurrences and counts are aggregates, and the chunks of
one document are the largest list.

Defined cases: a null text is empty; rows that repeat id and text are one document and get the same
result; null ids are kept and sort first; an empty text has no chunks; columns
beside id and text are dropped, whatever their names; a text of any length is cut whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import bitmap, in_bitmap, slices, stored
from tickwise.llm.spans import keyed, remove

LEAST = 16  # bytes of a chunk, but for the last of a text

_GEAR = np.frombuffer(b"".join(hashlib.sha256(b"gear" + bytes([b])).digest()[:4] for b in range(256)), np.uint32)


def chunk_ends(text: bytes, target: int = 32, least: int = LEAST, most: int = 256) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    h, step = _GEAR[np.frombuffer(text, np.uint8)], 1
    while step < 32:
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(step) if len(h) > step else 0
        h = h + older
        step *= 2
    ends, last = [], 0
    for e in (np.flatnonzero(h < np.uint32((1 << 32) // target)) + 1).tolist():
        while e - last > most:
            last += most
            ends.append(last)
        if e - last >= least:
            ends.append(e)
            last = e
    while len(text) - last > most:
        last += most
        ends.append(last)
    if last < len(text):
        ends.append(len(text))
    return ends


def chunks(rows: DataFrame, repeated: np.ndarray | None = None) -> DataFrame:
    """(d1) of every chunk, or (d1, d2, id, mark, a, b, last) of the chunks whose d1 may be repeated."""
    def run(batches):
        digest = xxhash.xxh3_128_intdigest
        for b in slices(batches):
            found, of = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                ends = chunk_ends(text)
                found += [(digest(text[s:e]), s, e, e == len(text)) for s, e in zip([0, *ends], ends, strict=False)]
                of += [i] * len(ends)
            d = np.frombuffer(b"".join([f[0].to_bytes(16, "little") for f in found]), np.int64).reshape(-1, 2)
            if repeated is None:
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0])], names=["d1"])
                continue
            keep = in_bitmap(repeated, np.ascontiguousarray(d[:, 0]))
            at = np.array([f[1:] for f in found], np.int32).reshape(-1, 3)[keep]
            who = b.select([0, 1]).take(pa.array(np.array(of, np.int64)[keep]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[keep, 0]), pa.array(d[keep, 1]), *who.columns, pa.array(at[:, 0]), pa.array(at[:, 1]),
                 pa.array(at[:, 2] > 0)], names=["d1", "d2", "id", "mark", "a", "b", "last"])

    full = "d1 long, d2 long, id long, mark long, a int, b int, last boolean"
    return rows.select("id", "mark", "text").mapInArrow(run, "d1 long" if repeated is None else full)


def repeats(rows: DataFrame, run: int = LEAST) -> DataFrame:
    """(id, mark, a, b, first): chunks in runs of ``run`` bytes or more, or of a whole text, that all occur elsewhere."""
    often = bitmap(chunks(rows).groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"))
    seen = stored(chunks(rows, often), "chunks")
    where = F.struct("id", "mark", "a")
    twice = stored(seen.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(where).alias("first")).where("n > 1")
                   .drop("n"), "repeated")
    marked = seen.join(twice, ["d1", "d2"]).select("id", "mark", "a", "b", (F.col("first") == where).alias("first"), "last")
    per_text = marked.groupBy("id", "mark").agg(F.array_sort(F.collect_set(F.struct("a", "b", "first", "last"))).alias("c"))

    def long_runs(batches):
        for batch in slices(batches):
            out = []
            for i, c in enumerate(batch.column(2).to_pylist()):
                begin = 0
                for k in range(1, len(c) + 1):
                    if k == len(c) or c[k]["a"] != c[k - 1]["b"]:
                        if c[k - 1]["b"] - c[begin]["a"] >= run or c[begin]["a"] == 0 and c[k - 1]["last"]:
                            out += [(i, x["a"], x["b"], x["first"]) for x in c[begin:k]]
                        begin = k
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            who = batch.select([0, 1]).take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*who.columns, pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_())],
                names=["id", "mark", "a", "b", "first"])

    return per_text.mapInArrow(long_runs, "id long, mark long, a int, b int, first boolean")


def dedup(docs: DataFrame, run: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
          keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, n_repeated): a row for each document.

    ``n_repeated`` counts the bytes of its repeats, first occurrences included.
    """
    rows = keyed(docs, id_col, text_col)
    found = stored(repeats(rows, run), "repeats")
    kept = remove(rows, found.where("not first").select("id", "mark", "a", "b"), keep_text, also_key=True)
    sums = found.groupBy("id", "mark").agg(F.sum(F.col("b") - F.col("a")).alias("n_repeated"))
    return (kept.join(sums, ["id", "mark"], "left").drop("id", "mark", "carried")
            .withColumn("n_repeated", F.coalesce("n_repeated", F.lit(0))))
