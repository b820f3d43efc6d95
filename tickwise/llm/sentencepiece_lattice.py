"""SentencePiece encoding and decoding over a relational lattice.

A text is written as the model's normaliser does (a space in front, spaces as U+2581) and cut into
words: no piece goes on past a run of U+2581 that follows other characters, nor over a line break, so
words can be segmented apart. The distinct words are the nodes of a relation:

* explode the substrings that begin at every character: one, two, and the lengths of the pieces that begin with
  the same three characters, so never longer than the longest of them,
* equi-join them to the piece table (of fixed size, the vocabulary, so it is broadcast),
* gather the matches of a part's words (below): the edges of their lattices,
* fold Viterbi over them, by end, in all words of a part at once: per end the best score, and a back pointer (the
  last piece and its length; of equal scores the longest), so the fold's work grows with the edges. A character without a
  piece may be spelt in bytes (one edge, the score below every piece's, as the library's unknown character). The ids are
  read off the back pointers once.

Scores are those of the model file, and the segmentation is the one of the largest sum of scores.

How words travel: texts are dealt to buckets of about ``BUCKET`` bytes, once, compressed. A bucket sends its
distinct words, sorted and compressed, to word parts (their number grows with the root of that of buckets); each part encodes a word once
for all buckets, and answers every bucket's list with the ids in the same order. So each word moves as
a few bytes, the vocabulary is never gathered, and a frequent word weighs no more than others. Words are handed to
the lattice in slices of ``SLICE`` characters (each with the few that follow), so no word is too long for a row.

Defined cases: a null or empty text has no ids; characters outside the vocabulary become byte pieces (or
the unknown piece where the model has none); a word of any length is segmented whole; null ids are kept, repeated rows
get a row each; other columns, whatever their names, are dropped; an empty table gives an empty one. Decoding gives back the text exactly, but for
U+2581 in it, which the model takes for a space.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm.common import id_and_text, slices

SPACE = "▁"
BUCKET = 8_000_000  # bytes of text that one task holds
BLOCK = 512  # more than the longest piece has characters
WORDS = 20_000  # words that are folded together
SLICE = 256  # characters of a word in one row of the lattice's input
# An edge is one long:
# end << 31 | length << 21 | code; a back pointer is code << 10 | length. The code is the piece's id + 1, 0 for none.
CODES = 1 << 21
WORD = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def model_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from a SentencePiece model file: its first field, a message each."""
    with open(path, "rb") as f:
        data = f.read()
    out, at = [], 0

    def fields(data, at, end):
        while at < end:
            tag, at = _varint(data, at)
            if tag & 7 == 2:
                n, at = _varint(data, at)
                yield tag >> 3, data[at:at + n]
                at += n
            elif tag & 7 == 5:
                yield tag >> 3, data[at:at + 4]
                at += 4
            elif tag & 7 == 1:
                at += 8
            else:
                value, at = _varint(data, at)
                yield tag >> 3, value

    for field, value in fields(data, at, len(data)):
        if field == 1:
            got = dict(fields(value, 0, len(value)))
            out.append((got[1].decode(), float(np.frombuffer(got.get(2, b"\0" * 4), "<f4")[0]), got.get(3, 1)))
    return out


def piece_table(spark: SparkSession, pieces: list[tuple[str, float, int]]) -> DataFrame:
    """(piece, id, score) of the normal pieces, type 1."""
    rows = [(p, i, s) for i, (p, s, kind) in enumerate(pieces) if kind == 1]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def starts_table(spark: SparkSession, pieces: list[tuple[str, float, int]]) -> DataFrame:
    """(start, lengths): the first three characters of longer pieces, and how long pieces may be there: 1, 2, and as those are."""
    lengths: dict[str, set] = {}
    for p, _, kind in pieces:
        if kind == 1 and len(p) > 2:
            lengths.setdefault(p[:3], set()).add(len(p))
    return spark.createDataFrame([(p, [1, 2, *sorted(n)]) for p, n in lengths.items()], "start string, lengths array<int>")


def words_of(text: str) -> list[str]:
    """The words of one text, in order; joined, they are the normalised text."""
    if not text:
        return []
    if SPACE in text:
        return WORD.findall(SPACE + text.replace(" ", SPACE))
    # the same cuts by plain replacements: a mark before every word, none inside a run of spaces
    got = SPACE + text.replace(" ", f" {SPACE}")
    twin = f"{SPACE} {SPACE}"
    if twin in got:
        got = got.replace(twin, SPACE * 2).replace(twin, SPACE * 2)
    if "\n" in got:
        return list(filter(None, got.replace("\n", " \n ").split(" ")))
    return got.split(" ")


def sliced(place: int, word: str, longest: int):
    """(place, at, own, chars) of the slices of one word: ``own`` characters, and those a piece may go on to."""
    for at in range(0, len(word), SLICE):
        yield place, at, min(SLICE, len(word) - at), word[at:at + SLICE + longest - 1]


def edges_of(words: DataFrame, keys: list[str], pieces: list[tuple[str, float, int]]) -> DataFrame:
    """(keys..., e): the edges of the words' lattices, one row each.

    ``words(keys..., at, own, chars)`` are the slices of words; ``keys`` tell words apart.
    """
    spark = words.sparkSession
    slot = [*keys, "at"]
    begins = (words.select(*slot, "chars", F.length("chars").alias("n"), F.explode(F.sequence(F.lit(1), "own")).alias("i"))
              .join(F.broadcast(starts_table(spark, pieces)), F.expr("substring(chars, i, 3) = start"), "left"))  # the vocabulary
    spans = (begins.select(*slot, "i", "n", "chars", F.explode(F.expr("coalesce(lengths, array(1, 2))")).alias("k"))
             .where("i + k - 1 <= n"))
    return (spans.select(*keys, (F.col("at") + F.col("i") + F.col("k") - 1).alias("end"), "k",
                         F.expr("substring(chars, i, k)").alias("piece"))
            .join(F.broadcast(piece_table(spark, pieces)), "piece", "left")  # the vocabulary
            .where("id is not null or k = 1")
            .select(*keys, F.expr("shiftleft(bigint(end), 31) | bigint(shiftleft(k, 21) | coalesce(id + 1, 0))").alias("e")))


def code_scores(pieces: list[tuple[str, float, int]]) -> np.ndarray:
    """Scores by code: a character without a piece scores below every piece."""
    return np.array([min(s for _, s, kind in pieces if kind == 1) - 10.0, *(s for _, s, _ in pieces)])


def best_backs(place: np.ndarray, e: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, back): Viterbi over the edges of words 0 to n - 1, an end at a time in all of them.

    Word w has the back pointers ``back[bounds[w]:bounds[w + 1]]``: a 0, then code << 10 | length of the last piece per end.
    """
    end, length, code = (e >> 31).astype(np.int32), (e >> 21 & 1023).astype(np.int32), (e & CODES - 1).astype(np.int32)
    # every character has an edge of one character
    bounds = np.concatenate([[0], np.cumsum(np.bincount(place[length == 1], minlength=n) + 1)])
    by_end = np.argsort(end.astype(np.int16) if end.max(initial=0) < 1 << 15 else end, kind="stable")  # small numbers sort faster
    at, length, code = (bounds[place] + end)[by_end], length[by_end], code[by_end]
    best, back = np.full(bounds[-1], -np.inf), np.zeros(bounds[-1], np.int64)
    best[bounds[:-1]] = 0.0
    for a, b in pairwise(np.cumsum(np.bincount(end)).tolist()):
        to, k = at[a:b], length[a:b]
        total = best[to - k] + scores[code[a:b]]
        np.maximum.at(best, to, total)
        top = total == best[to]  # of equal sums the longest last piece
        np.maximum.at(back, to[top], k[top].astype(np.int64) << 21 | code[a:b][top])
    return bounds, (back & CODES - 1) << 10 | back >> 21


def segment(words: DataFrame, keys: list[str], pieces: list[tuple[str, float, int]]) -> DataFrame:
    """(keys..., back): for each character of a word where its best segmentation up to there comes from.

    ``words(keys..., at, own, chars)`` are the slices of words; ``keys`` tell words apart. ``back`` holds a 0, then
    code << 10 | length of the last piece per end.
    """
    scores = code_scores(pieces)
    lattice = edges_of(words, keys, pieces)

    def fold(t):
        e = t.column("e").to_numpy()
        _, back = best_backs(np.zeros(len(e), np.int64), e, scores, 1)
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "back": pa.array([back], pa.list_(pa.int32()))})

    return lattice.groupBy(*keys).applyInArrow(fold, f"{lattice.select(*keys).schema.simpleString()[7:-1]}, back array<int>")


def longest_piece(pieces: list[tuple[str, float, int]]) -> int:
    longest = max(len(p) for p, _, kind in pieces if kind == 1)
    if longest >= BLOCK or len(pieces) >= CODES:
        raise ValueError(f"pieces of less than {BLOCK} characters, and less than {CODES} of them")
    return longest


def read_back(back: list[int], word: str, byte_ids: list[int]) -> list[int]:
    """The ids of one word off its back pointers, unknown characters as the ids of their bytes."""
    ids, end = [], len(back) - 1
    while end:
        code, length = back[end] >> 10, back[end] & 1023
        if code:
            ids.append(code - 1)
        else:
            ids += [byte_ids[b] for b in reversed(word[end - 1].encode())]
        end -= length
    ids.reverse()
    return ids


def read_all(bounds: np.ndarray, back: np.ndarray, words: list[str], byte_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids of all words in a row): ``read_back`` for many words, a piece at a time in all of them."""
    n = len(words)
    at, where, steps = bounds[1:] - 1, np.arange(n), []
    while len(where):
        going = at > bounds[where]
        at, where = at[going], where[going]
        steps.append((where, at - bounds[where], back[at] >> 10))
        at = at - (back[at] & 1023)
    where, end, code = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else [np.zeros(0, np.int64)] * 3
    order = np.lexsort((end, where))
    where, end, code = where[order], end[order], code[order]
    spelt = np.ones(len(code), np.int64)
    unknown = {int(i): [byte_ids[b] for b in words[where[i]][end[i] - 1].encode()] for i in np.flatnonzero(code == 0)}
    spelt[list(unknown)] = [len(x) for x in unknown.values()]
    ids = np.repeat((code - 1).astype(np.int32), spelt)
    first = np.cumsum(spelt) - spelt
    for i, x in unknown.items():
        ids[first[i]:first[i] + len(x)] = x
    return np.bincount(where, spelt, n).astype(np.int64), ids


def _pack(words: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(json.dumps(words, ensure_ascii=False).encode())


def _unpack(blob: bytes) -> list[str]:
    return json.loads(zstandard.ZstdDecompressor().decompress(blob))


def _pack_ids(sizes: np.ndarray, flat: np.ndarray) -> bytes:
    """Id lists in a row: their sizes, then all ids, in the smallest type that holds them."""
    wide = bool(max(sizes.max(initial=0), flat.max(initial=0)) > 65_535)
    both = np.concatenate([sizes, flat]).astype(np.int32 if wide else np.uint16)
    return bytes([wide]) + zstandard.ZstdCompressor(level=3).compress(both.tobytes())


def _unpack_ids(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids of all lists in a row) of ``n`` lists."""
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.int32 if blob[0] else np.uint16)
    return got[:n].astype(np.int64), got[n:].astype(np.int32)


def _blocks(batches):
    """(bucket, block) of (bucket, doc_id, text): the rows of a batch for one bucket, compressed together."""
    for b in slices(batches, 2048):
        by_bucket: dict[int, list] = {}
        for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            by_bucket.setdefault(bucket, []).append(row)
        packer = zstandard.ZstdCompressor(level=3)
        blocks = [packer.compress(json.dumps(x, ensure_ascii=False).encode()) for x in by_bucket.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(by_bucket), pa.int32()), pa.array(blocks, pa.binary())],
                                         names=["bucket", "block"])


def _rows(t: pa.Table):
    """The (doc_id, text) rows of a bucket's blocks, a block at a time."""
    for x in t.column("block"):
        yield from json.loads(zstandard.ZstdDecompressor().decompress(x.as_py()))


def _part(word: str, parts: int) -> int:
    return zlib.crc32(word.encode()) % parts


def _lists(texts, parts: int) -> dict[int, list[str]]:
    """The distinct words of some texts by the part that encodes them, sorted."""
    words: set[str] = set()
    for t in texts:
        words.update(words_of(t))
    out: dict[int, list[str]] = {}
    for w in sorted(words):
        out.setdefault(_part(w, parts), []).append(w)
    return out


def _gathered(words: np.ndarray, first: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The ids of a text, given as numbers of words: word w has the ``sizes[w]`` ids from ``first[w]`` on."""
    n = sizes[words]
    return ids[np.repeat(first[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def encode(docs: DataFrame, pieces: list[tuple[str, float, int]], id_col: str = "doc_id", text_col: str = "text",
           bucket: int = BUCKET) -> DataFrame:
    """(doc_id, ids): the piece ids of each row's whole text; ``pieces`` as ``model_pieces`` reads them."""
    rows = id_and_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // bucket))
    parts = math.ceil(16 * buckets ** 0.5)  # a list per bucket and part: fewer parts than buckets once there are many
    longest, scores = longest_piece(pieces), code_scores(pieces)
    known = {int(m[1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6 and (m := BYTE.match(p))}
    byte_ids = [known.get(b, next((i for i, p in enumerate(pieces) if p[2] == 2), 0)) for b in range(256)]
    dealt = (rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text")
             .mapInArrow(_blocks, "bucket int, block binary").repartition(buckets, "bucket"))

    def list_words(t):
        lists = _lists((x for _, x in _rows(t)), parts)
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()] * len(lists), pa.int32()),
                         "part": pa.array(list(lists), pa.int32()),
                         "words": pa.array([_pack(x) for x in lists.values()], pa.binary())})

    def words_of_part(blobs: list[bytes]) -> list[str]:
        return sorted({w for x in blobs for w in _unpack(x)})

    def unpack(t):
        words = words_of_part(t.column("words").to_pylist())
        place, at, own, chars = list(zip(*(x for i, w in enumerate(words) for x in sliced(i, w, longest)), strict=True))
        return pa.table({"part": pa.array([t.column("part")[0].as_py()] * len(place), pa.int32()),
                         "place": pa.array(place, pa.int32()), "at": pa.array(at, pa.int32()),
                         "own": pa.array(own, pa.int32()), "chars": pa.array(chars, pa.string())})

    def answer(lists, edges):
        blobs = lists.column("words").to_pylist()
        words = words_of_part(blobs)
        place, e = edges.column("place").to_numpy(), edges.column("e").to_numpy()
        found = []
        for a in range(0, len(words), WORDS):  # so that the arrays in between stay small
            some = words[a:a + WORDS]
            own = (place >= a) & (place < a + WORDS)
            found.append(read_all(*best_backs(place[own] - a, e[own], scores, len(some)), some, byte_ids))
        sizes, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        first = np.cumsum(sizes) - sizes
        number = {w: i for i, w in enumerate(words)}
        out = []
        for x in blobs:
            asked = _unpack(x)
            at = np.fromiter(map(number.__getitem__, asked), np.int64, len(asked))
            out.append(_pack_ids(sizes[at], _gathered(at, first, sizes, ids)))
        return pa.table({"bucket": lists.column("bucket"), "part": lists.column("part"), "ids": pa.array(out, pa.binary())})

    def assemble(texts, answers):
        number: defaultdict[str, int] = defaultdict()  # words in the order they are met
        number.default_factory = number.__len__
        doc_ids, coded = [], []
        for doc_id, text in _rows(texts):
            words = words_of(text)
            doc_ids.append(doc_id)
            coded.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        asked: dict[int, list[int]] = {}  # the words of each list, in its order
        for w in sorted(number):
            asked.setdefault(_part(w, parts), []).append(number[w])
        first, sizes = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        del number
        found, base = [], 0
        for part, blob in zip(answers.column("part").to_pylist(), answers.column("ids").to_pylist(), strict=True):
            where = np.array(asked.pop(part), np.int64)
            n, ids = _unpack_ids(blob, len(where))
            sizes[where], first[where] = n, base + np.cumsum(n) - n
            found.append(ids)
            base += len(ids)
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        del found
        out = [_gathered(w, first, sizes, ids) for w in coded]
        ends = np.cumsum([0, *map(len, out)])
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.concatenate(out), pa.int32()))})

    lists = (dealt.groupBy("bucket").applyInArrow(list_words, "bucket int, part int, words binary")
             .repartition(parts, "part"))
    # dealt by part alone, the words stay where they are through lattice, fold and answer
    words = (lists.groupBy("part").applyInArrow(unpack, "part int, place int, at int, own int, chars string")
             .repartition(parts, "part"))
    edges = edges_of(words, ["place", "part"], pieces)
    answers = (lists.groupBy("part").cogroup(edges.groupBy("part"))
               .applyInArrow(answer, "bucket int, part int, ids binary"))
    return (dealt.groupBy("bucket").cogroup(answers.groupBy("bucket"))
            .applyInArrow(assemble, "doc_id long, ids array<int>"))


def decode(encoded: DataFrame, pieces: list[tuple[str, float, int]]) -> DataFrame:
    """``encoded(doc_id, ids, ...)`` with ``text``: pieces joined, byte pieces read as UTF-8, U+2581 as a space.

    Bytes that are no UTF-8 become U+FFFD; null ids give an empty text.
    """
    raw = [bytes([int(m[1], 16)]) if kind == 6 and (m := BYTE.match(p)) else p.replace(SPACE, " ").encode()
           for p, _, kind in pieces]
    table = F.split(F.lit(",".join(x.hex() for x in raw)), ",")  # folded to one literal, the vocabulary
    written = F.unhex(F.array_join(F.transform(F.coalesce("ids", F.expr("cast(array() as array<int>)")),
                                               lambda i: F.element_at(table, i + 1)), ""))
    return encoded.withColumn("text", F.substring(F.make_valid_utf8(written.cast("string")), 2, (1 << 31) - 1))
