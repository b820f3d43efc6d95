"""Periodic runs against a brute force over all starts and periods."""

import hashlib
import random
import re
import zlib

import pytest

from tickwise.llm import periodic_runs as P


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(a == b for a, b in zip(w, w[q:], strict=False)))


def plain_runs(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // 2 + 1):
        start = 0
        while start + q < len(w):
            end = start + q
            while end < len(w) and w[end] == w[end - q]:
                end += 1
            if end - start >= max(least, exponent * q) and smallest_period(w[start:end]) == q:
                out.append((start, end - start, q))
            start = max(start + 1, end - q + 1)
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def sequences(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        w = []
        while len(w) < rng.randint(0, 60):
            piece = [rng.randint(0, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 7))]
            w += piece * rng.choice([1, 1, 2, 3, 4, 5, 9])
            w = w[:len(w) - rng.randint(0, 2)] if w else w
        yield w


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (7, 3), (12, 5)])
def test_runs_equal_brute_force(least, exponent):
    for w in sequences(least, 400):
        assert P.find_runs(w, least, exponent) == plain_runs(w, least, exponent), w


def test_runs_of_fibonacci_and_unary_words():
    a, b = [0], [0, 1]
    while len(b) < 150:
        a, b = b, b + a
    for w in (b, [5] * 200, [1, 2] * 90 + [1, 2, 2] * 30):
        assert P.find_runs(w, 2, 2) == plain_runs(w, 2, 2)
        assert P.find_runs(w) == plain_runs(w)


def test_pruned_texts_lose_no_run():
    texts = [[b"%d" % x for x in w] for w in sequences(5, 300)]
    assert P.runs_of_texts(texts, 6, 4) == [plain_runs(t) for t in texts]
    assert any(plain_runs(t) for t in texts)
    prose = [[b"%d" % random.Random(1).randint(0, 400) for _ in range(3000)]]
    assert P.runs_of_texts(prose, 6, 4) == [plain_runs(prose[0])]


def test_a_long_text_without_and_with_a_run():
    rng = random.Random(3)
    body = [b"%d" % int(rng.paretovariate(0.6)) for _ in range(60_000)]
    phrase = body[100:700]
    with_run, without = P.runs_of_texts([body + phrase * 6, body], 6, 4)
    assert max(n for _, n, q in with_run if q == 600) >= 3600 and all(q < 600 for _, _, q in without)


ROWS = [(1, "a b " * 6, "x"), (2, None, "x"), (3, "", "x"), (4, " \t\n ", "x"), (None, "go " * 7, "x"),
        (5, "no run here at all", "x"), (5, "no run here at all", "x"), (6, "é é " * 8 + "end", None),
        (7, "w" * 50_000, "x"), (8, "x " * 20_000, "x")]


def test_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, runs string").repartition(3)
    got = P.periodic_runs(docs).collect()
    want = []
    for i, text, _ in ROWS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words) if len(words) < 1000 else [(0, 20_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((str(i), len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_query_equals_the_contract_in_plain_python(spark, tmp_path):
    from tickwise.llm.queries import QUERIES
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))) for _ in range(120)] + [None, "", "one"]
    rows = list(enumerate(texts)) + [(3, "again " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()), key=str)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        runs = plain_runs(w)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
            "".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(x for k, x in enumerate(w) if k not in gone))]
        want.append((i, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2], *sha))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 5
