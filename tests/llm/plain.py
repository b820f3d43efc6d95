"""Plain single-machine versions that the tests compare operators with."""

from __future__ import annotations

import re
from collections import Counter

import xxhash


def plain_simhash(text: str | None, k: int) -> int:
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(
        bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(rows: list[tuple[int, str | None]], k: int, bits: int) -> dict[int, int]:
    """doc_id -> smallest doc_id reachable over links of at most ``bits`` differing bits."""
    fps = [(i, plain_simhash(t, k)) for i, t in rows]
    parent = {i: i for i, _ in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(fps):
        for j, b in fps[:n]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def removed_text(texts: dict[int, str | None], length: int) -> dict[int, str]:
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(d[i:i + length] for d in data.values() for i in range(len(d) - length + 1))
    out = {}
    for key, d in data.items():
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out[key] = bytes(b for b, g in zip(d, gone, strict=True) if not g).decode(errors="ignore")
    return out


NUMBER_WORDS = set("""two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
    seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
    billion half dozen""".split())


def template_windows(text: str | None, width: int, least: int, units: set[str] = frozenset()) -> list[tuple]:
    """Windows of template words with the pattern of their slots; windows of too few plain words are left out."""
    words, fresh, number = [], True, False
    for t in re.findall(r"\d+(?:[.,]\d+)*|\w+|[.!?:\n]", text or ""):
        if t in ".!?:\n":
            fresh = True
            continue
        low = t.lower()
        kind = ("<num>" if t[0].isdigit() or low in NUMBER_WORDS else "<unit>" if number and low in units
                else "<name>" if t[0].isupper() and not fresh else "")
        number, fresh = kind == "<num>", False
        words.append((kind, low))
    out = []
    n = min(width, len(words))
    for i in range(len(words) - n + 1 if n else 0):
        part = words[i:i + n]
        slots = [w for w in part if w[0]]
        if n - len(slots) >= least:
            out.append((tuple(k or w for k, w in part), tuple(slots.index(s) for s in slots)))
    return out


def best_segmentation(word: str, pieces: dict[str, tuple[int, float]], longest: int, unknown: float) -> list[int]:
    """Viterbi over one word; ``pieces`` are (id, score) by piece; of equal sums the longest last piece."""
    best, back = [0.0], [None]
    for end in range(1, len(word) + 1):
        ways = []
        for k in range(1, min(longest, end) + 1):
            found = pieces.get(word[end - k:end]) or ((-1 - ord(word[end - 1]), unknown) if k == 1 else None)
            if found:
                ways.append((best[end - k] + found[1], k, found[0]))
        top = max(ways)
        best.append(top[0])
        back.append(top[1:])
    ids, end = [], len(word)
    while end:
        ids.append(back[end][1])
        end -= back[end][0]
    return ids[::-1]
