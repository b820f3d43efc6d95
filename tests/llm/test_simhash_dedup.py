"""SimHash near-dedup against all pairs."""

import random

import pytest

from tests.llm.plain import components_of, plain_simhash
from tickwise.llm import simhash_dedup


def texts(seed=1, n=140):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    out = [None, "", " \t\n", "one", "one two", "One TWO three", "one  two\nthree", "É é a", "x" * 50_000, "a b c " * 3000]
    while len(out) < n:
        base = [word() for _ in range(rng.randint(1, 60))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):  # near copies
            base[rng.randrange(len(base))] = word()
            out.append(" ".join(base))
    return out


@pytest.mark.parametrize(("bits", "long_list"), [(2, 128), (2, 0), (3, 1), (1, 128), (0, 128), (6, 3)])
def test_components_match_all_pairs(spark, bits, long_list):
    rows = list(enumerate(texts(bits)))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, root int").repartition(3)
    got = simhash_dedup.near_duplicates(docs, 3, bits, long_list=long_list).collect()
    want = components_of(rows, 3, bits)
    assert {r.doc_id: r.component_id for r in got} == want
    by_id = dict(rows)
    assert all(r.fp % (1 << 64) == plain_simhash(by_id[r.doc_id], 3) for r in got)


def test_links_are_complete_up_to_connectivity_on_close_fingerprints(spark):
    rng = random.Random(6)
    fps = set()
    for _ in range(5):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for b in rng.sample(range(20), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bits in (1, 2, 3):
        for long_list in (0, 10, 1000):
            got = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_dedup.links(frame, bits, long_list).collect()}
            assert all((a ^ b).bit_count() <= bits for a, b in got)
            groups = {}
            for pairs in (got, {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits}):
                parent = {x: x for x in fps}

                def find(x, parent=parent):
                    while parent[x] != x:
                        x = parent[x]
                    return x

                for a, b in pairs:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
                groups[len(groups)] = {x: find(x) for x in fps}
            assert groups[0] == groups[1]


def test_keep_one_and_null_ids(spark):
    rows = [(4, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "quite another text here"), (9, None), (7, ""),
            (8, "lonely words stand alone"), (8, "lonely words stand alone")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, mark string")
    got = simhash_dedup.keep_one(docs).collect()
    assert sorted((str(r.doc_id), r.text, r.mark) for r in got) == sorted(
        (str(i), t, "k") for i, t in [(2, "a b c d"), (None, "quite another text here"), (7, ""), (8, "lonely words stand alone")])
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
