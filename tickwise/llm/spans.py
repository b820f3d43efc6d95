"""Removal of byte ranges from the texts of documents."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import bitmap, id_and_text, in_bitmap, slices

NO_ID = -(1 << 63)  # stands for a null id in keys
# carried columns keep their microseconds
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str] | None = None) -> DataFrame:
    """(id, mark, text binary, carried): ``mark`` tells texts under one id apart.

    ``carried`` is JSON of the columns named in ``carry``, null without any.
    """
    rows = id_and_text(docs, id_col, text_col)
    carried = F.lit(None).cast("string")
    if carry:
        rows = docs.select(F.to_json(F.struct(*carry), JSON).alias("carried"),
                           F.col(id_col).cast("long").alias("doc_id"),
                           F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        carried = F.col("carried")
    return rows.select(carried.alias("carried"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("mark"),
                       F.col("text").cast("binary").alias("text"))


def cut_out(text: bytes, ranges) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs and the rest of a text, for half-open ranges in any order."""
    runs: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    rest, at = [], 0
    for a, b in runs:
        rest.append(text[at:a])
        at = b
    return sum(b - a for a, b in runs), len(runs), b"".join([*rest, text[at:]])


def remove(rows: DataFrame, found: DataFrame, keep_text: bool = True, also_key: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, carried) for each of ``keyed`` rows.

    ``found(id, mark, a, b)`` is a stored table of the ranges a..b (b excluded) that go; ``kept`` is
    null without ``keep_text``; ``also_key`` leaves id and mark in. Only texts that lose something are moved.
    """
    touched = bitmap(found.select(F.xxhash64("id", "mark").alias("h")).distinct())
    out = ("id long, mark long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, "
           "carried string")

    def row(doc_id, mark, text, ranges, carried):
        removed, spans, kept = cut_out(text, ranges)
        return (doc_id, mark, len(text), removed, spans, kept if keep_text else None, hashlib.sha256(kept).hexdigest(),
                carried)

    types = [pa.int64()] * 5 + [pa.binary(), pa.string(), pa.string()]
    names = ["id", "mark", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "carried"]

    def columns(made, types):
        cols = list(zip(*made, strict=True)) if made else [[]] * len(types)
        return [pa.array(c, t) for c, t in zip(cols, types, strict=True)]

    def sift(batches):  # documents without a repeat are finished here, the others take their text along
        for b in slices(batches):
            hit = in_bitmap(touched, b.column(2).to_numpy(zero_copy_only=False)).tolist()
            ids, marks, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            rest = b.column(4).to_pylist()
            made = [(t, i, m, *[None] * 5, c) if h else (None, *row(i, m, t, None, c))
                    for i, m, t, h, c in zip(ids, marks, texts, hit, rest, strict=True)]
            yield pa.RecordBatch.from_arrays(columns(made, [pa.binary(), *types]), names=["text", *names])

    def finish(batches):
        for b in slices(batches):
            made = [row(r["id"], r["mark"], r["text"], r["ranges"], r["carried"]) if r["text"] is not None else tuple(r[n] for n in names)
                    for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays(columns(made, types), names=names)

    sifted = (rows.select("id", "mark", F.xxhash64("id", "mark").alias("h"), "text", "carried")
              .mapInArrow(sift, "text binary, " + out))
    ranges = found.groupBy("id", "mark").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    done = sifted.join(ranges, ["id", "mark"], "left").mapInArrow(finish, out)
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    return done.select(*(["id", "mark"] if also_key else []), doc_id, *names[2:])
