"""Token counts by finite-state transducers, composed over chunks of text.

``Transducer`` compiles the merges of a byte-level BPE vocabulary into a deterministic automaton over
bytes. Its state is the longest suffix of the word so far that begins a token, and knows the tokens
that may end there; which one does is settled by the token that ends where it would begin, since two
neighbours of a tokenisation never merge over their seam. A transition holds the next state only: the count
is found by looking back, over the last token and the count at each byte of the word so far. Transitions
and seams are worked out when first met; the tables are bounded.

Texts are cut into chunks of ``chunk`` characters. White space after another character always begins a
new word, whatever came before, so chunks resynchronise there. A chunk's state map is no table over the
automaton's states, but: what it does to the open word it is entered with (its text up to the first such place), the
tokens it emits between its first and last such place, and the word it leaves open. ``compose``
is associative; the maps of one text are combined pairwise, in a tree, in one loop in one task. A text
without white space has no such place: it travels whole as head and is counted in that task.

Special tokens inside a text count as one token each, as the library does by default.

Defined cases: a null text is empty and has no tokens; repeated rows get a row each; null ids stay.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import id_and_text

SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # fixed: Unicode White_Space
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the tokenizer's own
MAX_MOVES = MAX_FITS = 300_000
MAX_MEMO = 200_000


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Deterministic automaton over the beginnings of tokens, with the tokens that may end in each state."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        raw = [bytes([b]) for b in range(256)]
        self.number = {t: i for i, t in enumerate(dict.fromkeys([*raw, *(a + b for a, b in merges)]))}
        self.parts = {}  # token -> the two tokens it was merged from; tokens are numbered in order of merging
        for a, b in reversed(merges):
            self.parts[self.number[a + b]] = (self.number[a], self.number[b])
        self.merged = {pair: t for t, pair in self.parts.items()}
        self.names = [b"", *dict.fromkeys(t[:i] for t in self.number for i in range(1, len(t) + 1))]
        self.states = {t: i for i, t in enumerate(self.names)}
        self.ends: list[tuple | None] = [None] * len(self.names)
        self.moves: dict[int, int] = {}
        self.fits: dict[int, bool] = {}

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side: no merge over the seam comes before one that made them.

        The merges that made the two tokens are undone, the latest first; before each, the parts that
        face the seam must not have merged earlier. Equal merges are applied from the left.
        """
        key, limit = left << 20 | right, len(self.number)
        while True:
            if self.merged.get((left, right), limit) < limit:
                fit = False
                break
            on_left, on_right = left if left in self.parts else -1, right if right in self.parts else -1
            if on_left > on_right:
                limit, left = on_left, self.parts[left][1]
            elif on_right >= 0:
                limit, right = on_right + 1, self.parts[right][0]
            else:
                fit = True
                break
        if len(self.fits) >= MAX_FITS:
            self.fits.clear()
        self.fits[key] = fit
        return fit

    def _move(self, state: int, byte: int) -> int:
        """The longest suffix, after one more byte, that begins a token; its list of ends is made with it."""
        name = self.names[state] + bytes([byte])
        while name not in self.states:
            name = name[1:]
        to = self.states[name]
        if self.ends[to] is None:  # the longest token first
            self.ends[to] = tuple((len(name) - i, self.number[name[i:]]) for i in range(len(name))
                                  if name[i:] in self.number)
        if len(self.moves) >= MAX_MOVES:
            self.moves.clear()
        self.moves[state << 8 | byte] = to
        return to

    def count(self, word: bytes) -> int:
        """Tokens of one word (a string that the merges see alone).

        At each byte the one token that ends there is found among those of the state: it must fit the token
        that ends where it begins, and the count there, plus one, is the count here.
        """
        state, last, count = 0, [-1], [0]
        moves, fits, ends = self.moves, self.fits, self.ends
        for i, byte in enumerate(word, 1):
            to = moves.get(state << 8 | byte)
            state = self._move(state, byte) if to is None else to
            for n, token in ends[state]:
                before = last[i - n]
                if before < 0:
                    break
                fit = fits.get(before << 20 | token)
                if self._fit(before, token) if fit is None else fit:
                    break
            last.append(token)
            count.append(count[i - n] + 1)
        return count[-1]


class Memo(dict):
    """key -> compute(key). Two generations of ``size`` keys at most: what is used again stays."""

    def __init__(self, compute, size: int):
        self.compute, self.size, self.old = compute, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Counter:
    """Tokens of a piece of text that begins and ends where a word does."""

    def __init__(self, transducer: Transducer, special: list[str]):
        pattern = WORDS.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.words = regex.compile(pattern)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.of_word = Memo(lambda w: transducer.count(w.encode()), MAX_MEMO)
        self.known = Memo(self._count, MAX_MEMO)

    def _count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self.of_word[w] for p in parts for w in self.words.findall(p))

    def __getitem__(self, text: str) -> int:
        return self.known[text]


def load(path: str) -> Counter:
    """The counter of a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = {}
    for pair in spec["model"]["merges"]:
        for part in (pair if isinstance(pair, list) else pair.split(" ")):
            raw.setdefault(part, bytes(letters[c] for c in part))
    pairs = [tuple(raw[x] for x in (p if isinstance(p, list) else p.split(" "))) for p in spec["model"]["merges"]]
    return Counter(Transducer(pairs), [t["content"] for t in spec["added_tokens"]])


def state_map(counter: Counter, chunk: str) -> tuple[str, int, str | None]:
    """(head, tokens, tail) of a chunk; without an inner place that begins a word, (chunk, 0, None)."""
    segments = SEGMENT.findall(chunk)
    if len(segments) < 2:
        return chunk, 0, None
    return segments[0], sum(map(counter.known.__getitem__, segments[1:-1])), segments[-1]


def compose(counter: Counter, a: tuple, b: tuple) -> tuple[str, int, str | None]:
    """The state map of two neighbouring pieces of text."""
    if a[2] is None and b[2] is None:
        return state_map(counter, a[0] + b[0])
    if a[2] is None:
        head, n, tail = state_map(counter, a[0] + b[0])
        return (head, b[1], b[2]) if tail is None else (head, n + counter[tail] + b[1], b[2])
    if b[2] is None:
        head, n, tail = state_map(counter, a[2] + b[0])
        return (a[0], a[1], head) if tail is None else (a[0], a[1] + counter[head] + n, tail)
    head, n, tail = state_map(counter, a[2] + b[0])
    inner = counter[head] if tail is None else counter[head] + n + counter[tail]
    return a[0], a[1] + inner + b[1], b[2]


def total(counter: Counter, maps: list[tuple]) -> int:
    """Tokens of a text from the state maps of its chunks in order."""
    while len(maps) > 1:
        maps = [compose(counter, *maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    if not maps:
        return 0
    head, n, tail = maps[0]
    return counter[head] + n + (0 if tail is None else counter[tail])


def token_counts(docs: DataFrame, tokenizer: str, chunk: int = 1 << 16, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row's whole text; ``tokenizer`` is a file that every worker can read."""
    def maps(batches):
        counter = load(tokenizer)
        for b in batches:
            found = [state_map(counter, t) for t in b.column(4).to_pylist()]
            whole = b.column(2).to_pylist()
            ready = [total(counter, [m]) if n == 1 else None for m, n in zip(found, whole, strict=True)]
            left = [("", 0, "") if n == 1 else m for m, n in zip(found, whole, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(5), pa.array(ready, pa.int64()), b.column(3),
                 *(pa.array(x, t) for x, t in zip(zip(*left, strict=True) if left else [[]] * 3,
                                                  (pa.string(), pa.int64(), pa.string()), strict=True))],
                names=["key", "doc_id", "n_bytes", "n_tokens", "seq", "head", "inner", "tail"])

    def scan(batches):
        counter = None
        for b in batches:
            counts = b.column(2).to_pylist()
            for i, row in enumerate(b.column(3).to_pylist()):
                if counts[i] is None:
                    counter = load(tokenizer) if counter is None else counter
                    counts[i] = total(counter, [(m["head"], m["inner"], m["tail"]) for m in row])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    n = F.greatest(F.ceil(F.length("text") / chunk), F.lit(1)).cast("int")
    pieces = (id_and_text(docs, id_col, text_col)
              .select(F.monotonically_increasing_id().alias("key"), "doc_id", n.alias("n"),
                      F.octet_length("text").cast("long").alias("n_bytes"), "text")
              .select("key", "doc_id", "n", "n_bytes", F.posexplode(
                  F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                              lambda i: F.substring("text", i * chunk + 1, F.lit(chunk)))).alias("seq", "piece"))
              .select("key", "doc_id", "n", "seq", "piece", "n_bytes"))
    mapped = pieces.mapInArrow(maps, "key long, doc_id long, n_bytes long, n_tokens long, seq int, "
                                     "head string, inner long, tail string")
    # a row per text meets here, or per chunk of a long text, each with two words at most
    states = F.array_sort(F.collect_list(F.when(F.col("n_tokens").isNull(), F.struct("seq", "head", "inner", "tail"))))
    texts = mapped.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"),
                                      F.max("n_tokens").alias("n_tokens"), states.alias("maps"))
    return (texts.select("doc_id", "n_bytes", "n_tokens", "maps")
            .mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long"))
