"""Exact removal of long repeated byte strings by prefix-free parsing.

Parsing. A rolling hash of ``w`` bytes is taken at every byte; the places where it is least among some
``T`` neighbouring places are triggers. Triggers cut a text into phrases of at most ``T`` bytes, and
whether a place is one depends on the ``T`` places around it only. So a string of ``length`` bytes has,
wherever it occurs, the same first trigger among the places that lie ``T - 1`` or more behind its start:
its anchor. Every start belongs to the phrase occurrence of its anchor.

Dictionary. A phrase entry is the stretch of text that all starts of one anchor can see: ``core`` (what
every one of them covers) with its left and right context. Entries are grouped by core, then by
the whole stretch. A core that occurs once ends every repeat, so most of the corpus leaves here. Entries
equal in the whole stretch are repeated at all their starts.

Corpus order. The remaining entries of one core differ in their context. The suffixes of these entries
(one for each start; ``length`` bytes decide, so no suffix is compared further and the order of the parse
behind it never matters) are sorted, and a start is repeated if its neighbour in that order is equal
over ``length`` bytes. Cores with more than ``crowd`` different entries are not sorted in one task:
their suffixes are dealt by hash and counted.

Memory and traffic: the text moves only for documents that hold a disputed entry or a repeat. Which
they are, and which cores occur twice, is told to the tasks by bitmaps of fixed size; what they let
through by accident meets an exact join.

Defined cases: a null text is empty; matches never cross documents; repeated rows are documents of their
own (and so repeat each other); null ids are kept; texts shorter than ``length`` stay whole; columns
beside id and text are dropped by ``dedup``, whatever their names, and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickwise.llm.common import bitmap, cut, in_bitmap, slices, stored
from tickwise.llm.spans import JSON, keyed, remove

_GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:4] for b in range(256)), np.uint32)


class Parser:
    """Phrase occurrences of a text for repeats of ``length`` bytes."""

    def __init__(self, length: int):
        if length < 8:
            raise ValueError("length must be at least 8")
        self.length = length
        self.w = 16 if length >= 100 else 4 if length >= 24 else 1
        self.reach = (length - self.w + 3) // 3 - 1  # T - 1
        self.core = length - self.reach

    def triggers(self, text: bytes) -> np.ndarray:
        span, n = self.reach + 1, len(text) - self.w + 1
        if n < span:
            return np.zeros(0, np.int64)
        h, step, c = _GEAR[np.frombuffer(text, np.uint8)], 1, np.uint32(0x9E3779B1)
        while step < self.w:
            h = h[:-step] * c + h[step:]
            c, step = np.uint32(int(c) ** 2 & 0xFFFFFFFF), 2 * step
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        low = h.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)
        size = 1
        while size < span:
            move = min(size, span - size)
            low = np.minimum(low[:-move], low[move:])
            size += move
        at = low.astype(np.uint32).astype(np.int64)
        return at[np.flatnonzero(np.diff(at, prepend=-1))]

    def occurrences(self, text: bytes) -> list[tuple[int, int, int]]:
        """(base, lo, hi) of each anchor: its starts lie in lo..hi, its core begins at base >= hi."""
        out, before, last = [], -1, len(text) - self.length
        for p in self.triggers(text).tolist():
            base = p - self.reach
            lo, hi = max(0, before - self.reach + 1) if before >= 0 else 0, min(base, last)
            before = p
            if lo <= hi:
                out.append((base, lo, hi))
        return out


def _cores(rows: DataFrame, parser: Parser) -> DataFrame:
    def run(batches):
        digest, core = xxhash.xxh3_64_intdigest, parser.core
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                found = [digest(text[base:base + core]) for base, _, _ in parser.occurrences(text)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], names=["core"])

    return rows.select("text").mapInArrow(run, "core long")


def _entries(rows: DataFrame, parser: Parser, repeated: np.ndarray) -> DataFrame:
    """(core, whole, id, mark, base, lo, hi) of the occurrences whose core may occur twice."""
    def run(batches):
        digest, core, length = xxhash.xxh3_64_intdigest, parser.core, parser.length
        for b in slices(batches):
            out, of = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                spans = parser.occurrences(text)
                cores = np.array([digest(text[s[0]:s[0] + core]) for s in spans], np.uint64)
                for j in np.flatnonzero(in_bitmap(repeated, cores)).tolist():
                    base, lo, hi = spans[j]
                    out.append((int(cores[j]), digest(text[lo:hi + length], seed=base - lo), base, lo, hi))
                    of.append(i)
            a = np.array(out, np.uint64).reshape(-1, 5).view(np.int64)
            who = b.select([0, 1]).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[:, 0]), pa.array(a[:, 1]), *who.columns, *(pa.array(a[:, k].astype(np.int32)) for k in (2, 3, 4))],
                names=["core", "whole", "id", "mark", "base", "lo", "hi"])

    return rows.select("id", "mark", "text").mapInArrow(run, "core long, whole long, id long, mark long, base int, lo int, hi int")


def _contexts(rows: DataFrame, disputed: DataFrame, parser: Parser) -> DataFrame:
    """(core, whole, id, mark, base, lo, hi, left, right): what surrounds the core of disputed entries."""
    wanted = bitmap(disputed.select(F.xxhash64("id", "mark").alias("h")).distinct())

    def pick(batches):
        for b in slices(batches):
            yield b.select([0, 1, 3]).filter(pa.array(in_bitmap(wanted, b.column(2).to_numpy(zero_copy_only=False))))

    texts = (rows.select("id", "mark", F.xxhash64("id", "mark").alias("h"), "text")
             .mapInArrow(pick, "id long, mark long, text binary"))
    per_text = disputed.groupBy("id", "mark").agg(
        F.collect_list(F.struct("core", "whole", "base", "lo", "hi")).alias("spots"))

    def around(batches):
        core, reach = parser.core, parser.reach
        for b in slices(batches):
            for i, (text, spots) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                n = len(spots)
                cols = [[s[k] for s in spots] for k in ("core", "whole", "base", "lo", "hi")]
                left = [text[s["lo"]:s["base"]] for s in spots]
                right = [text[s["base"] + core:s["base"] + core + reach] for s in spots]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     *(pa.array([b.column(k)[i].as_py()] * n, pa.int64()) for k in (0, 1)),
                     *(pa.array(c, pa.int32()) for c in cols[2:]), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["core", "whole", "id", "mark", "base", "lo", "hi", "left", "right"])

    return texts.join(per_text, ["id", "mark"]).select("id", "mark", "text", "spots").mapInArrow(
        around, "core long, whole long, id long, mark long, base int, lo int, hi int, left binary, right binary")


def _suffix(row: dict, x: int, reach: int) -> bytes | None:
    """The start ``x`` bytes before the core: what its string holds besides the core (None: no such start)."""
    if not row["base"] - row["hi"] <= x <= row["base"] - row["lo"]:
        return None
    left = row["left"]
    return left[len(left) - x:] + row["right"][:reach - x]


def _ranges(starts: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of consecutive sorted numbers."""
    out: list[list[int]] = []
    for s in starts:
        if out and out[-1][1] == s - 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [tuple(r) for r in out]


RANGES = "id long, mark long, a int, b int"


def _sorted_repeats(contexts: DataFrame, parser: Parser) -> DataFrame:
    """Repeated starts of the entries of each core, by sorting the suffixes of its entries."""
    def order(table):
        rows, reach = table.to_pylist(), parser.reach
        hit: list[list[int]] = [[] for _ in rows]
        for x in range(reach + 1):  # suffixes that begin x bytes before the core
            suffixes = sorted((suffix, i) for i, row in enumerate(rows) if (suffix := _suffix(row, x, reach)) is not None)
            for (one, i), (other, j) in zip(suffixes, suffixes[1:], strict=False):
                if one == other:
                    hit[i].append(rows[i]["base"] - x)
                    hit[j].append(rows[j]["base"] - x)
        out = [(row["id"], row["mark"], a, b) for row, s in zip(rows, hit, strict=True)
               for a, b in _ranges(sorted(set(s)))]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("id", "mark", "a", "b"), cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})

    return contexts.groupBy("core").applyInArrow(order, RANGES)


def _counted_repeats(contexts: DataFrame, parser: Parser) -> DataFrame:
    """The same for crowded cores: suffixes are dealt by hash, so no task holds a whole core."""
    def spread(batches):
        for b in slices(batches):
            for row in b.to_pylist():
                xs, keys = [], []
                for x in range(row["base"] - row["hi"], row["base"] - row["lo"] + 1):
                    xs.append(row["base"] - x)
                    keys.append(xxhash.xxh3_128_digest(_suffix(row, x, parser.reach), seed=x))
                n = len(xs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["core"]] * n, pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([row["id"]] * n, pa.int64()), pa.array([row["mark"]] * n, pa.int64()),
                     pa.array(xs, pa.int32())], names=["core", "suffix", "id", "mark", "a"])

    all_suffixes = contexts.mapInArrow(spread, "core long, suffix binary, id long, mark long, a int")
    twice = cut(all_suffixes.groupBy("core", "suffix").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    return all_suffixes.join(twice, ["core", "suffix"]).select("id", "mark", "a", F.col("a").alias("b"))


def repeated_starts(rows: DataFrame, length: int, crowd: int = 4000) -> DataFrame:
    """(id, mark, a, b): every start in a..b of that text begins a string of ``length`` bytes that
    also starts anywhere else; ``rows`` are those of ``spans.keyed``."""
    parser = Parser(length)
    repeated = bitmap(_cores(rows, parser).groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    entries = stored(_entries(rows, parser, repeated), "phrases")
    kinds = entries.groupBy("core", "whole").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "mark", "base", "lo", "hi")).alias("first"))
    kinds = stored(kinds, "dictionary")
    cores = stored(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"), "cores")
    settled = (entries.join(kinds.where("n > 1").select("core", "whole"), ["core", "whole"])
               .select("id", "mark", F.col("lo").alias("a"), F.col("hi").alias("b")))
    open_kinds = kinds.join(cores, "core").select("core", "whole", "first.*", "kinds")
    contexts = stored(_contexts(rows, open_kinds, parser), "contexts")
    few = contexts.join(cores.where(F.col("kinds") <= crowd), "core", "left_semi")
    many = contexts.join(cores.where(F.col("kinds") > crowd), "core", "left_semi")
    return settled.union(_sorted_repeats(few, parser)).union(_counted_repeats(many, parser))


def dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
          crowd: int = 4000, keep_text: bool = True, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, carried): a row for each document.

    Every byte goes that lies in a string of ``length`` bytes which also starts anywhere else,
    judged on the input. ``kept`` holds the remaining bytes, or null without ``keep_text``;
    ``carried`` is JSON of the columns named in ``carry``.
    """
    rows = keyed(docs, id_col, text_col, carry)
    starts = repeated_starts(rows, length, crowd)
    return remove(rows, stored(starts.withColumn("b", F.col("b") + length), "repeats"), keep_text)


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``docs(doc_id, text, ...)``, all columns, with the kept text; ``n_chars``, if there, is counted anew.

    Bytes of a character that was cut through go too. A null text becomes an empty one; null ids, repeated rows and
    extra columns of any name and type are kept, an empty table stays empty. The other columns travel beside the text, which moves once.
    """
    others = [f for f in docs.schema.fields if f.name not in ("text", "n_chars")]
    done = dedup(docs, length, carry=[f.name for f in others])

    def read(batches):
        for b in slices(batches):
            texts = [t.decode(errors="ignore") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["carried", "kept_text"])

    texts = done.select("carried", "kept").mapInArrow(read, "carried string, kept_text string")
    rows = texts.select("kept_text", F.from_json("carried", T.StructType(others), JSON).alias("row"))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
