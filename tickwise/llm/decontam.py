"""Benchmark decontamination by template windows.

Texts become templates: numbers, names and units turn into typed placeholders. Windows of ``width``
template words of the documents are joined by hash to those of the benchmark, so a question that comes
back with other numbers or names still meets its original. Over all windows of one document that line up
with one item at one offset, a slot value of the item that changed must stand for one value of the document
(two values of the item may become the same one); a window with a changed value that stands for several is
dropped, alone. Windows without slots, or with the item's own values, stay whatever else is on their line.
Windows with fewer than ``min_words`` words that are no slots say too little in running text. They are joined on their
words as they stand (in lower case), anywhere where they have ``RUNNING`` words or more, else only where they
begin and end with a sentence of the document: a question "Who wrote Hamlet?" counts where it is asked, an item "the" does
not mark every text that holds the word. Where such a window is its whole item and has a word besides slots, its
template counts too, likewise from the beginning to the end of a sentence: "What is 13 times 8?" meets "What is 12 times 7?". The first word
of an item, a capital that opens a sentence, counts both as a word and as a name: a document may quote
the item in mid-sentence.

The benchmark's hashes go to the tasks in blocks of at most ``block`` windows, one pass over the
documents per block, so what a task holds is bounded whatever the benchmark's size. Of benchmark
windows with one template and one pattern of equal slot values the smallest item speaks for all, beside the smallest
with the document's own values: a benchmark made of one template meets a window once per pattern (15 at
most for four slots), not once per item.

Defined cases: a null text is empty and clean; an item of fewer words than the window is one window; an item
without any word has none (``without_windows`` counts them); repeated rows get a row each; null ids
are kept; very long texts are read whole, one row at a time; columns beside id and text are ignored in matching, whatever their
names, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwise.llm.common import cut, id_and_text, slices

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|\w+|[.!?:\n]")
# fixed lists of the template language
NUMBERS = frozenset("""two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
    seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
    billion half dozen""".split())
UNITS = frozenset("""mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce
    ounces pound pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour
    hours day days week weeks month months year years percent dollar dollars cent cents euro euros degree degrees
    meter meters metre metres kilometer kilometers kilometre kilometres mph kmh""".split())
STOP, CAPITAL, NUMBER, UNIT, FLAGS = 1, 2, 4, 8, 15
SLOTS = ("<name>", "<num>", "<unit>")
HELD = 200_000  # words remembered by a task
RUNNING = 4  # words of a literal window that counts inside a sentence
LITERAL, WHOLE = 1 << 32, 1 << 33  # set hashes of literal windows and of those that fill sentences apart


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) & ~FLAGS


class _Words(dict):
    """Word -> 60 bits of its lower-case hash and four bits of what it may be."""

    def __missing__(self, word: str) -> int:
        low = word.lower()
        flags = (STOP * (word in ".!?:\n") | CAPITAL * word[0].isupper() | NUMBER * (word[0].isdigit() or low in NUMBERS)
                 | UNIT * (low in UNITS))
        if len(self) >= HELD:
            self.clear()
        value = self[word] = _hash(low) | flags
        return value


def template(text: str, words: _Words) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, bool]:
    """Words of a text, their hashes, kinds of slot (0: none), which open a sentence, and whether the first is a capital."""
    tokens = TOKEN.findall(text)
    codes = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    flags = (codes & np.uint64(FLAGS)).astype(np.uint8)
    stop = (flags & STOP) > 0
    first = np.ones(len(codes), bool)  # of a sentence
    first[1:] = stop[:-1]
    keep = ~stop
    flags, first, codes = flags[keep], first[keep], codes[keep]
    number = (flags & NUMBER) > 0
    kind = np.where((flags & CAPITAL > 0) & ~first, 1, 0).astype(np.uint8)
    kind[number] = 2
    unit = (flags & UNIT) > 0
    unit[1:] &= number[:-1]
    unit[:1] = False
    kind[unit] = 3
    opens = bool(len(kind) and kind[0] == 0 and flags[0] & CAPITAL)
    return ([t for t, k in zip(tokens, keep.tolist(), strict=True) if k], codes & ~np.uint64(FLAGS), kind, first, opens)


_SLOT_HASHES = np.array([0] + [_hash(s) for s in SLOTS], np.uint64)


def _windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n <= 0:
        return out
    for j in range(width):
        out = (out ^ hashes[j:n + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _typed(codes: np.ndarray, kinds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` template words, and its number of words besides slots."""
    out = _windows(np.where(kinds > 0, _SLOT_HASHES[kinds], codes), width)
    plain = np.zeros(len(out), np.int64)
    for j in range(width if len(out) else 0):
        plain += kinds[j:len(out) + j] == 0
    return out ^ np.uint64(width), plain


def _literal(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words as they stand."""
    return _windows(codes, width) ^ np.uint64(width | LITERAL)


def _filling(first: np.ndarray, width: int) -> np.ndarray:
    """Which windows of ``width`` words begin and end with a sentence."""
    ends = np.append(first[1:], True)
    return first[:len(first) - width + 1] & ends[width - 1:]


def _describe(words: list[str], kinds: np.ndarray, at: int, width: int, literal: bool,
              whole: bool) -> tuple[str, list[str]]:
    """Template text and slot values of one window."""
    sign = "^ " * whole
    if literal:
        return f"{sign}= " + " ".join(words[at:at + width]).lower(), []
    shown, values = [], []
    for w, k in zip(words[at:at + width], kinds[at:at + width].tolist(), strict=True):
        if k:
            shown.append(SLOTS[k - 1])
            values.append(SLOTS[k - 1] + w.lower())
        else:
            shown.append(w.lower())
    return sign + " ".join(shown), values


WINDOW = "pos int, width int, literal boolean, whole boolean, hash long, template string, slots array<string>"
_TYPES = [pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.string())]


def windows(rows: DataFrame, keys: list[str], width: int, min_words: int,
            forms: list[tuple[int, bool, bool]] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """Windows of documents, ``rows(keys..., text)``, whose hash is in the sorted ``wanted``.

    ``forms`` are the (width, literal, whole) to look for. Without them and ``wanted``, the windows of items: a
    text shorter than ``width`` is one; those with too few words besides slots as the module's text says.
    """
    def of_item(words, codes, kinds, opens):
        n = min(width, len(words))
        as_name = kinds.copy()
        as_name[:1] = 1
        for form, last in ((kinds, None), (as_name, 1)) if opens else ((kinds, None),):
            got, plain = _typed(codes, form, n)
            literal = _literal(codes, n)
            for p in range(len(got) if n else 0)[:last]:
                if plain[p] >= min_words:
                    yield p, n, False, False, got[p], form
                    continue
                whole = n < RUNNING
                yield p, n, True, whole, literal[p] ^ np.uint64(WHOLE * whole), form
                if plain[p] and n == len(words):
                    yield p, n, False, True, got[p] ^ np.uint64(WHOLE), form

    def of_document(codes, kinds, first):
        for n, literal, whole in forms:
            if n > len(codes):
                continue
            if literal:
                got, good = _literal(codes, n), True
            else:
                got, plain = _typed(codes, kinds, n)
                good = plain >= (1 if whole else min_words)
            if whole:
                got, good = got ^ np.uint64(WHOLE), good & _filling(first, n)
            spot = np.minimum(np.searchsorted(wanted, got), len(wanted) - 1)
            for p in np.flatnonzero(good & (wanted[spot] == got)).tolist():
                yield p, n, literal, whole, got[p], kinds

    def found_in(text, known):
        words, codes, kinds, first, opens = template(text, known)
        found = of_item(words, codes, kinds, opens) if wanted is None else of_document(codes, kinds, first)
        for p, n, literal, whole, h, form in found:
            yield p, n, literal, whole, int(h.astype(np.int64)), *_describe(words, form, p, n, literal, whole)

    def run(batches):
        known = _Words()
        for b in slices(batches):
            at, found = [], []
            for row, text in enumerate(b.column(len(keys)).to_pylist()):
                before = len(found)
                found += dict.fromkeys((*w[:-1], tuple(w[-1])) for w in found_in(text, known))
                at += [row] * (len(found) - before)
            picked = b.select(list(range(len(keys)))).take(pa.array(at, pa.int64()))
            columns = list(zip(*found, strict=True)) if found else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays(
                [*picked.columns, *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))],
                names=[*keys, "pos", "width", "literal", "whole", "hash", "template", "slots"])

    types = dict(rows.dtypes)
    return rows.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + WINDOW)


def without_windows(benchmark: DataFrame, item_text: str = "text") -> int:
    """How many items no document can be found with: those without a word."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([all(t in ".!?:\n" for t in TOKEN.findall(x or "")) for x in b.column(0).to_pylist()], pa.bool_())],
                names=["none"])

    return benchmark.select(F.col(item_text).cast("string")).mapInArrow(run, "none boolean").where("none").count()


def speakers(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, template, first) by pattern of equal slot values, (hash, template, slots, first) by slot values.

    ``first`` is the smallest (item_id, pos, slots).
    """
    first = F.min(F.struct("item_id", "pos", "slots")).alias("first")
    pattern = F.expr("transform(slots, x -> array_position(slots, x))").alias("pattern")
    return (cut(asked.groupBy("hash", "template", pattern).agg(first).drop("pattern")),
            cut(asked.groupBy("hash", "template", "slots").agg(first)))


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_words: int = 4, block: int = 1_000_000,
            doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, mark, item_id, shift, n_windows, n_changed): lined-up windows without conflicting slots.

    ``mark`` is the XXH64 of the document's text, which tells rows of one id apart; ``shift`` is
    the distance of the places in document and item; ``n_changed`` counts slot values that differ.
    """
    items = id_and_text(benchmark, item_id, item_text).withColumnRenamed("doc_id", "item_id")
    asked = cut(windows(items, ["item_id"], width, min_words))
    rows = id_and_text(docs, doc_id, doc_text).withColumn("mark", F.xxhash64("text"))
    forms = ["width", "literal", "whole"]
    sizes = asked.groupBy(*forms).agg(F.count("*").alias("n")).collect()  # four rows per width at most
    forms, n = sorted((r.width, r.literal, r.whole) for r in sizes), sum(r.n for r in sizes)
    blocks = max(1, -(-n // block))
    found = None
    for i in range(blocks):
        part = asked.where(F.pmod("hash", F.lit(blocks)) == i).select("hash").distinct().toArrow()
        wanted = np.sort(part.column(0).to_numpy().astype(np.int64).view(np.uint64))
        if len(wanted):
            got = windows(rows, ["doc_id", "mark"], width, min_words, forms, wanted)
            found = got if found is None else found.union(got)
    if found is None:
        return rows.limit(0).select("doc_id", "mark", F.lit(None).cast("long").alias("item_id"),
                                    F.lit(0).alias("shift"), F.lit(0).alias("n_windows"), F.lit(0).alias("n_changed"))
    found = cut(found)
    by_pattern, by_values = speakers(asked)
    same = ["hash", "template"]
    met = (found.join(by_pattern, same).select("doc_id", "mark", "pos", "slots", "first")
           .union(found.join(by_values, [*same, "slots"]).select("doc_id", "mark", "pos", "slots", "first")))
    line = ["doc_id", "mark", "item_id", "shift"]
    pairs = cut(met.select(
        "doc_id", "mark", "first.item_id", (F.col("pos") - F.col("first.pos")).alias("shift"), "pos",
        F.explode_outer(F.arrays_zip(F.col("first.slots").alias("item_slots"), F.col("slots").alias("slots"))).alias("slot")))
    # one exchange: a line holds an item's windows at most, and all that follows is dealt by lines
    pairs = pairs.repartition(*line).distinct().select(
        *line, "pos", "slot", F.expr("coalesce(slot.item_slots <> slot.slots, false)").alias("changed"))
    value = Window.partitionBy(*line, "slot.item_slots")
    judged = pairs.withColumn("several", F.min("slot.slots").over(value) != F.max("slot.slots").over(value))
    spots = (judged.groupBy(*line, "pos").agg(
        F.bool_or(F.expr("changed and several")).alias("conflict"),
        F.collect_set(F.when(F.col("changed"), F.col("slot"))).alias("changes"))
        .where("not coalesce(conflict, false)"))
    return (spots.select(*line, "pos", F.explode_outer("changes").alias("change")).groupBy(*line).agg(
        F.count_distinct("pos").cast("int").alias("n_windows"), F.count_distinct("change").cast("int").alias("n_changed")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_words: int = 4,
                  min_windows: int = 1, **columns) -> DataFrame:
    """(doc_id, contaminated, item_id, n_windows, n_changed): a row for each document.

    The item is the one with the most lined-up windows, then the fewest changed values, then the smallest.
    """
    found = matches(docs, benchmark, width, min_words, **columns).where(F.col("n_windows") >= min_windows)
    best = found.groupBy("doc_id", "mark").agg(
        F.max_by(F.struct("item_id", "n_windows", "n_changed"), F.struct("n_windows", -F.col("n_changed"), -F.col("item_id"))).alias("best"))
    rows = id_and_text(docs, columns.get("doc_id", "doc_id"), columns.get("doc_text", "text")).select(
        "doc_id", F.xxhash64("text").alias("mark"))
    best = cut(best.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "best"))
    return (rows.join(best, F.expr("mark = m and doc_id <=> d"), "left")
            .select("doc_id", F.col("best").isNotNull().alias("contaminated"), F.col("best.item_id").alias("item_id"),
                    F.coalesce("best.n_windows", F.lit(0)).alias("n_windows"),
                    F.coalesce("best.n_changed", F.lit(0)).alias("n_changed")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, min_words: int = 4,
                      min_windows: int = 1) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, all columns, that hold nothing of the benchmark."""
    found = matches(docs, benchmark, width, min_words).where(F.col("n_windows") >= min_windows)
    bad = cut(found.select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct())
    # the columns travel in one struct, so none of them can clash with the keys
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    return rows.join(bad, F.expr("mark = bad_mark and id <=> bad_id"), "left_anti").select("row.*")
