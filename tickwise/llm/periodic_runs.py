"""Periodic runs of words: a suffix automaton whose link tree is accessed as a link-cut tree.

A run is a stretch of words with smallest period q and length >= max(``least``, ``exponent`` * q) which
no neighbouring word extends keeping period q. The words of a text are appended to a suffix automaton one by
one. Its suffix links form a tree; a state holds the words sequences that end at the same places, so all of
them have one last occurrence. The tree is kept as a link-cut tree: each splay tree is a stretch of a path
to the root whose states have one last end. Appending word i makes the path from the newest state to the root end
at i (an access). Each stretch passed on the way tells its former last end e and, by its deepest state, the
longest sequence (length L) that ended there and ends at i again: where d = i - e <= L, the last L + d words
are a square of period d, and the smallest one, since e is the last end. It is extended to the right as far as
words d apart agree. Accesses change O(n log n) stretches in all.

Most texts hold no run, and the automaton need not see words that cannot lie in one. Where
``least`` >= 6 and ``exponent`` >= 4 a run covers each of its triples of neighbouring words at least three times. So
a text falls apart at triples that are rarer than that in their own stretch, again and again until no
stretch changes (``stretches``); hash collisions make triples look more frequent, never rarer, and other settings
leave texts whole. What is left, if anything, goes through the automaton.

Where it runs: in Arrow batches beside the rows, without a shuffle, so no key or group of copies gathers anywhere; a
lost executor repeats its batches. Memory follows ``slices`` of rows and the automaton of one stretch of one text.

Defined cases: a null or empty text, or one of white space, has no words, no runs and an empty collapsed text; a null
id stays null; repeated rows get a row each; an empty table gives an empty one; words are the runs of bytes other
than space and 0x09-0x0D, of any length; other columns of the input, whatever their names, are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickwise.llm.common import id_and_text, slices

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class LinkTree:
    """Suffix links as a link-cut tree; ``last`` holds, at the root of a splay tree, the last end of its states."""

    def __init__(self):
        self.up, self.shallow, self.deep, self.last = [-1], [-1], [-1], [-1]

    def add(self, parent: int) -> int:
        """A new state below ``parent``."""
        self.up.append(parent)
        self.shallow.append(-1)
        self.deep.append(-1)
        self.last.append(-1)
        return len(self.up) - 1

    def splay(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        p = up[x]
        if p < 0 or (shallow[p] != x and deep[p] != x):
            return
        while True:
            g = up[p]
            inner = g >= 0 and (shallow[g] == p or deep[g] == p)
            if inner:
                if (shallow[g] == p) == (shallow[p] == x):
                    self._rotate(p, g)
                    self._rotate(x, p)
                else:
                    self._rotate(x, p)
                    self._rotate(x, g)
                root = g
            else:
                self._rotate(x, p)
                root = p
            p = up[x]
            if p < 0 or (shallow[p] != x and deep[p] != x):
                self.last[x] = self.last[root]  # the former root of this splay tree
                return

    def _rotate(self, x: int, p: int) -> None:
        """x takes the place of its parent p inside a splay tree."""
        up, shallow, deep = self.up, self.shallow, self.deep
        g = up[p]
        if shallow[p] == x:
            b = deep[x]
            shallow[p], deep[x] = b, p
        else:
            b = shallow[x]
            deep[p], shallow[x] = b, p
        if b >= 0:
            up[b] = p
        if g >= 0:
            if shallow[g] == p:
                shallow[g] = x
            elif deep[g] == p:
                deep[g] = x
        up[p], up[x] = x, g

    def insert_above(self, x: int) -> int:
        """A new state between x and its parent, with the ends of x."""
        self.splay(x)
        y = self.add(x)
        above = self.shallow[x]
        self.shallow[y] = above
        if above >= 0:
            self.up[above] = y
        self.shallow[x] = y
        return y

    def access(self, x: int, end: int) -> list[tuple[int, int]]:
        """Let x and all above it end at ``end``: (former last end, deepest state) of the stretches passed."""
        up, deep, last = self.up, self.deep, self.last
        passed = []
        below = -1
        while x >= 0:
            self.splay(x)
            passed.append((last[x], x))
            cut = deep[x]
            if cut >= 0:
                last[cut] = last[x]  # deeper states off the path keep their end
            deep[x] = below
            below = x
            x = up[x]
        last[below] = end
        return passed


def squares(words: list[int]):
    """(end, start, period) of the longest square with each period at each end, in order of ends."""
    tree = LinkTree()
    length, moves = [0], [{}]
    link = [-1]
    newest = 0
    for i, w in enumerate(words):
        cur = len(length)
        length.append(length[newest] + 1)
        moves.append({})
        p = newest
        while p >= 0 and w not in moves[p]:
            moves[p][w] = cur
            p = link[p]
        if p < 0:
            parent = 0
        else:
            parent = moves[p][w]
            if length[parent] != length[p] + 1:
                old = parent
                tree.add(-1)  # numbers of tree and automaton stay the same: cur, then its clone
                parent = tree.insert_above(old)
                length.append(length[p] + 1)
                moves.append(dict(moves[old]))
                link.append(0)
                link.append(link[old])
                link[old] = parent
                tree.up[cur] = parent
                while p >= 0 and moves[p].get(w) == old:
                    moves[p][w] = parent
                    p = link[p]
                link[cur] = parent
                newest = cur
                for e, x in tree.access(cur, i)[1:]:
                    if 0 < i - e <= length[x] and e >= 0:
                        yield i, i - length[x] - (i - e) + 1, i - e
                continue
        link.append(parent)
        tree.add(parent)
        newest = cur
        for e, x in tree.access(cur, i)[1:]:
            if 0 < i - e <= length[x] and e >= 0:
                yield i, i - length[x] - (i - e) + 1, i - e


def find_runs(words: list[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one sequence, by start, then period."""
    n = len(words)
    covered: dict[int, int] = {}  # period -> end of the last run found with it
    out = []
    for i, start, q in squares(words):
        if i <= covered.get(q, -1):
            continue
        end = i + 1
        while end < n and words[end] == words[end - q]:
            end += 1
        covered[q] = end - 1
        if end - start >= max(least, exponent * q):
            out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def stretches(words: np.ndarray, text_of: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) stretches of neighbouring words (hashes) that can hold a run, of many texts in a row.

    A run of at least 6 words and 4 periods has length - 2 triples, of at most q kinds: each
    stands there (4q - 2) // q >= 3 times (q = 1: 4 of one kind).
    """
    if len(words) < 6:
        return []
    triples = _mix(_mix(words[:-2], words[1:-1]), words[2:])
    at = np.flatnonzero(text_of[:-2] == text_of[2:])
    group = text_of[at].astype(np.uint64)
    while len(at):
        _, kind, count = np.unique(_mix(triples[at], group), return_inverse=True, return_counts=True)
        often = at[count[kind] >= 3]
        if not len(often):
            return []
        new = np.flatnonzero(np.r_[True, (np.diff(often) != 1) | (np.diff(text_of[often]) != 0)])
        size = np.diff(np.r_[new, len(often)])
        kept = np.repeat(size >= 4, size)
        left = often[kept]
        if len(left) == len(at):
            return [(int(often[a]), int(often[a]) + int(s) + 2) for a, s in zip(new, size, strict=True) if s >= 4]
        group = np.repeat(np.arange(len(new), dtype=np.uint64), size)[kept]
        at = left
    return []


def runs_of_texts(texts: list[list[bytes]], least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.r_[0, np.cumsum(sizes)]
    if least >= 6 and exponent >= 4:
        hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(first[-1])).view(np.uint64)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        parts = stretches(hashes, text_of)
    else:
        parts = [(int(a), int(b)) for a, b in zip(first, first[1:], strict=False)]
    out: list[list] = [[] for _ in texts]
    for a, b in parts:
        t = int(np.searchsorted(first, a, side="right")) - 1
        at = a - int(first[t])
        ids: dict[bytes, int] = {}
        numbers = [ids.setdefault(w, len(ids)) for w in texts[t][at:at + b - a]]
        out[t] += [(start + at, length, q) for start, length, q in find_runs(numbers, least, exponent)]
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those that a run holds after its first period."""
    if runs:
        gone = np.zeros(len(words), bool)
        for start, length, q in runs:
            gone[start + q:start + length] = True
        words = [words[i] for i in np.flatnonzero(~gone)]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs by start then period, collapsed text) of each row."""
    if least < 2 or exponent < 2:
        raise ValueError("a run has at least two words and two periods")

    def run(batches):
        for b in slices(batches, 128):
            texts = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            found = runs_of_texts(texts, least, exponent)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found],
                         pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                pa.array([collapse(t, r) for t, r in zip(texts, found, strict=True)], pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
