"""Capped water-filling against the plain rounds, the sample against its promises, the query against DuckDB."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import pytest

from tickwise.llm import source_mix


def plain_targets(sizes, weights, share, epochs):
    """The rounds as one would do them by hand, in fractions: clamp, give the excess to the others, repeat."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total = Fraction(sum(sizes) * share, 100)
    target = [total * x / sum(w) for x in w]
    while True:
        cap = [epochs * s for s in sizes]
        excess = sum(t - c for t, c in zip(target, cap, strict=True) if t > c)
        free = [i for i, (t, c) in enumerate(zip(target, cap, strict=True)) if t < c]
        target = [min(t, Fraction(c)) for t, c in zip(target, cap, strict=True)]
        if not excess or not free:
            return target
        for i in free:
            target[i] += excess * w[i] / sum(w[j] for j in free)


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_the_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 40, 900, rng.randint(1, 10**9)]) for _ in range(rng.randint(1, 12))]
    weights = [[3, 1, 2], [1], [7, 1]][seed % 3]
    share, epochs = [(150, 2), (390, 4), (100, 1)][seed % 3]
    rows = [(i, f"s{i:02}", weights[i % len(weights)], s) for i, s in enumerate(sizes)]
    table = spark.createDataFrame(rows, "n long, source string, weight long, source_size long")
    want = plain_targets(sizes, weights, share, epochs)
    for r in source_mix.targets(table, share, epochs).collect():
        assert r.target == pytest.approx(float(want[r.n]), rel=1e-12)
        assert r.whole * r.source_size + r.rest == want[r.n].__floor__() or r.source_size == 0


def plain_sample(docs, wanted, fills):
    """Documents (place, size) taken once more, step by step."""
    taken, rest = set(), wanted
    for step in range(1 + fills):
        groups = {}
        for place, size in docs:
            if place not in taken and (step == 0 or 0 < size <= rest):
                groups[place] = groups.get(place, 0) + size
        sum_ = 0
        for place in sorted(groups):
            if sum_ + groups[place] > rest:
                break
            sum_ += groups[place]
            taken.add(place)
        rest -= sum_
    return taken


SOURCES = [None, "web", "web", "web", "web", "Ärger", "b", "b", "a"]


def make_rows(seed, n):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("xyz") for _ in range(rng.choice([0, 1, 3, 30, 200]))), rng.choice(SOURCES)) for i in range(n)]
    return rows + [(None, "null id", "web"), (3, None, "b"), (3, "same", "a"), (3, "same", "a"), (9, "", None), (10, "w " * 3000, "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_plain(spark, seed):
    rows = make_rows(seed, 400)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, target string")
    got = source_mix.mix(docs.repartition(5), [3, 1, 2]).collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(x for x, r in zip(size, rows, strict=True) if r[2] == s) for s in names]
    target = plain_targets(sizes, [3, 1, 2], 150, 2)
    want = []
    for s, n, t in zip(names, sizes, target, strict=True):
        mine = [(hashlib.sha256(f"1:{'' if i is None else i}:{x or ''}".encode()).hexdigest(), z, i)
                for (i, x, src), z in zip(rows, size, strict=True) if src == s]
        whole = int(t // n) if n else 2
        more = plain_sample([(p, z) for p, z, _ in mine], int(t) - whole * n, 2)
        want += [(str(i), str(s), z, n, z * (whole + (p in more))) for p, z, i in mine]
    assert sorted((str(r.doc_id), str(r.source), r.size, r.source_size, r.taken) for r in got) == sorted(want)
    again = source_mix.mix(docs.repartition(2), [3, 1, 2]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_taken_comes_near_the_target(spark):
    rows = make_rows(3, 600)
    got = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), [3, 1, 2]).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.taken
    assert all(0 <= t - taken <= 10 for t, taken in by.values())


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert source_mix.mix(docs.limit(0), [1]).count() == 0
    assert {(r.doc_id, r.target, r.taken) for r in source_mix.mix(docs, [3, 1]).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_query_equals_its_sql(spark, tmp_path):
    from tickwise.llm.queries import QUERIES, SQL
    docs = spark.createDataFrame(make_rows(4, 500), "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        got = QUERIES["op13_source_mix"](spark, sf)
        con = duckdb.connect()
        files = f"{sf}/documents.parquet/*.parquet" if sf == str(tmp_path) else f"{sf}/documents.parquet"
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
        cols = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL['op13_source_mix']})").fetchall()
        assert sorted(map(str, map(tuple, got.select(*cols).collect()))) == sorted(map(str, want))
