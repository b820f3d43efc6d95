"""Content-defined chunks: cutting rules, and dedup against a plain recomputation."""

import hashlib
import random
from collections import Counter

from tickwise.llm import chunk_dedup


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_chunks_cover_the_text_and_resist_insertions():
    rng = random.Random(3)
    for text in (b"", b"a", b"a" * 5000, prose(rng, 900).encode()):
        ends = chunk_dedup.chunk_ends(text)
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert sum(sizes) == len(text)
        assert all(16 <= s <= 256 for s in sizes[:-1])
    text = prose(rng, 900).encode()

    def pieces(t):
        ends = chunk_dedup.chunk_ends(t)
        return {t[a:b] for a, b in zip([0, *ends], ends, strict=False)}

    shifted = text[:2000] + b"inserted" + text[2000:]
    assert len(pieces(text) - pieces(shifted)) <= 8 < len(pieces(text))


def brute(rows, run):
    data = {(i if i is not None else -(1 << 63), t): (t or "").encode() for i, t in rows}
    spots = []
    for (i, t), d in data.items():
        ends = chunk_dedup.chunk_ends(d)
        spots += [(d[a:b], i, t, a, b) for a, b in zip([0, *ends], ends, strict=False)]
    n = Counter()
    for (i, t), _ in data.items():
        copies = sum(1 for r in rows if (r[0] if r[0] is not None else -(1 << 63), r[1]) == (i, t))
        for c, j, u, _a, _b in spots:
            if (j, u) == (i, t):
                n[c] += copies
    return data, spots, n


def test_matches_a_plain_recomputation(spark):
    rng = random.Random(11)
    shared = [prose(rng, 60) for _ in range(3)]
    texts = [None, "", "short", *shared[:1]]
    for _ in range(60):
        texts.append(prose(rng, rng.randint(0, 50)) + (rng.choice(shared) if rng.random() < 0.6 else "") + prose(rng, 20))
    texts.append(texts[7])
    rows = list(enumerate(texts[:-1])) + [(None, texts[-1]), (5, texts[5])]  # a null id; a row twice
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, first int").repartition(3)
    got = chunk_dedup.dedup(docs, run=120).collect()
    data, spots, n = brute(rows, 120)
    import xxhash
    mark = {}
    first = {}
    for c, i, t, a, _b in spots:
        key = (i, mark.setdefault(t, _signed(xxhash.xxh64_intdigest((t or "").encode(), 42))), a)
        first[c] = min(first.get(c, key), key)
    want = Counter()
    for (i, t), d in data.items():
        mine = sorted((a, b, c) for c, j, u, a, b in spots if (j, u) == (i, t) and n[c] > 1)
        runs, at = [], None
        for a, b, c in mine:
            if runs and runs[-1][-1][1] == a:
                runs[-1].append((a, b, c))
            else:
                runs.append([(a, b, c)])
        long = [x for r in runs if r[-1][1] - r[0][0] >= 120 for x in r]
        gone = [(a, b) for a, b, c in long if first[c] != (i, mark[t], a)]
        kept = b"".join(d[x:y] for x, y in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(d)], strict=True))
        copies = sum(1 for r in rows if (r[0] if r[0] is not None else -(1 << 63), r[1]) == (i, t))
        want[(i, len(d), sum(b - a for a, b in gone), hashlib.sha256(kept).hexdigest(),
              sum(b - a for a, b, _ in long))] += copies
    assert Counter((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256, r.n_repeated)
                   for r in got) == want
    assert sum(r.n_removed for r in got) > 5000


def test_short_repeats_stay_once(spark):
    rng = random.Random(5)
    line = "All rights reserved, see the license at the end. "
    texts = ["short", "a text of forty bytes that occurs twice.", "é" * 7]
    texts = texts * 2 + [prose(rng, 40) + " " + line * 2 + prose(rng, 40) for _ in range(6)] + ["short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in chunk_dedup.dedup(docs).collect()}
    assert [got[i].n_removed for i in (0, 1, 2)] == [0, 0, 0]
    assert all(got[i].kept == b"" and got[i].n_removed == len(texts[i].encode()) for i in (3, 4, 5, 12))
    seen, want = set(), Counter()
    for i, t in enumerate(texts):
        data = t.encode()
        ends = chunk_dedup.chunk_ends(data)
        for a, b in zip([0, *ends], ends, strict=False):
            if data[a:b] in seen:
                want[i] += b - a
            seen.add(data[a:b])
    assert {i: r.n_removed for i, r in got.items() if r.n_removed} == dict(want) and len(want) > 4


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_empty_table(spark):
    assert chunk_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
