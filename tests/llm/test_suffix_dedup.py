"""Suffix-array dedup against a direct count of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from tickwise.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n, passage):
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(passage) for _ in range(4)]
    texts = [None, "", "a", "x" * 300, "x" * 170, "ab" * 200, "abc" * 120, prose(150)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            texts.append(prose(rng.randint(0, 120)))
        elif kind < 0.7:
            texts.append(prose(rng.randint(0, 40)) + rng.choice(shared)[rng.randint(0, 20):] + prose(rng.randint(0, 40)))
        elif kind < 0.85:
            texts.append(rng.choice(texts))
        else:
            w = (rng.choice(texts) or "").split(" ")
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("length", "crowd", "passage"), [(40, 4000, 30), (40, 1, 30), (9, 4000, 5), (120, 2, 60)])
def test_matches_a_count_of_all_strings(spark, length, crowd, passage):
    texts = corpus(random.Random(length + crowd), 80, passage)
    ids = [*range(len(texts) - 2), None, 3]  # a null id, and one that two texts share
    docs = spark.createDataFrame([(i, t, "x", -1) for i, t in zip(ids, texts, strict=True)],
                                 "doc_id long, text string, mark string, core int").repartition(3)
    got = suffix_dedup.dedup(docs, length, crowd=crowd).collect()
    want = sorted(((-1 if i is None else i), *b) for i, b in zip(ids, brute(texts, length), strict=True))
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in got) == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.dedup(docs, 400).count() == 0


def test_triggers_are_never_further_apart_than_the_window():
    rng = random.Random(5)
    for length in (8, 30, 100, 400):
        parser = suffix_dedup.Parser(length)
        for text in (b"a" * 2000, bytes(rng.choices(b"ab", k=3000)), bytes(rng.choices(range(256), k=3000))):
            at = parser.triggers(text).tolist()
            assert at[0] <= parser.reach
            assert max(b - a for a, b in zip(at, at[1:], strict=False)) <= parser.reach + 1
            starts = [i for base, lo, hi in parser.occurrences(text) for i in range(lo, hi + 1)]
            assert starts == list(range(len(text) - length + 1))


def test_other_columns_come_through_unchanged(spark):
    import datetime as dt
    when = dt.datetime(2024, 5, 6, 7, 8, 9, 456789)
    long = "some words that are repeated in two documents " * 20
    rows = [(1, long, when, float("nan"), b"\x00\xff", ["a", None], "x"), (2, "kept " + long, None, 0.1, None, None, "y"),
            (None, None, when, float("inf"), b"", [], None), (2, "kept " + long, None, 0.1, None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, seen timestamp, v double, raw binary, tags array<string>, carried string")
    got = suffix_dedup.without_repeats(docs.withColumn("n_chars", F.lit(7)), 400)
    assert got.columns == [*docs.columns, "n_chars"]
    plain = lambda df: sorted(map(str, df.select("doc_id", "seen", "v", "raw", "tags", "carried").collect()))
    assert plain(got) == plain(docs)
    assert all(r.n_chars == len(r.text) < 100 for r in got.collect())
    assert suffix_dedup.without_repeats(docs.limit(0), 400).count() == 0
