"""Document fingerprints against plain Python, and the block tables against all pairs."""

import hashlib
import random

import xxhash

from tickwise.llm import fingerprints
from tickwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(text):
    votes = [0] * 64
    for w in (text or "").lower().translate(str.maketrans("\t\n\x0b\f\r", "     ")).split(" "):
        weight = max(0, min(len(w) - 1, fingerprints.MAX_WEIGHT))
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        for b in range(64):
            votes[b] += weight if h >> b & 1 else -weight
    return sum(1 << b for b in range(64) if votes[b] > 0)


def expected(rows):
    ids = sorted({i for i, _ in rows}, key=lambda i: -(1 << 63) if i is None else i)
    donor = {}
    for i, t in rows:
        key = xxhash.xxh64_intdigest((t or "").encode(), 42)
        key = key - (1 << 64) if key >> 63 else key
        donor[i] = min(donor.get(i, (1 << 64, "")), (key, t or ""))
    out = []
    for i, t in rows:
        t, after = t or "", donor[ids[ids.index(i) - 1]][1]
        k = len(t) // 2
        edited = t[:len(t) - k] + after[:k]
        out.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), plain(t), plain(edited), plain(after)))
    return sorted(out)


def test_edited_texts_match_plain(spark):
    rng = random.Random(1)
    rows = [(i * 7, " ".join(rng.choice(["Été", "river", "stone", "the", "a", "𝄞x", "mountains"]) for _ in range(rng.randint(0, 40))))
            for i in range(60)]
    rows += [(1, None), (2, ""), (3, "z"), (None, "null id text"), (14, "another text of id fourteen"), (21, rows[3][1]), (4, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, fp int, id int").repartition(5)
    got = fingerprints.edited_against_next(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, *(x % (1 << 64) for x in (r.fp, r.edited_fp, r.next_fp)))
                  for r in got) == expected(rows)
    assert {r.doc_id: r.fp % (1 << 64) for r in fingerprints.fingerprints(docs).collect() if r.doc_id != 14} == {
        i: plain(t) for i, t in rows if i != 14}


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(5, "only one text here")], "doc_id long, text string")
    r = fingerprints.edited_against_next(docs).first()
    assert r.fp == r.next_fp and r.n_chars == 18
    assert fingerprints.edited_against_next(docs.limit(0)).count() == 0


def test_block_tables_miss_nothing(spark):
    rng = random.Random(3)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        c = rng.getrandbits(64)
        values |= {c ^ sum(1 << b for b in rng.sample(range(64), k)) for k in range(7)}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for radius, blocks in ((0, None), (1, None), (3, None), (3, 6), (5, None)):
        got = [(r.query % (1 << 64), r.fp % (1 << 64)) for r in fingerprints.within(frame, frame.limit(80), radius, blocks).collect()]
        asked = {r.fp % (1 << 64) for r in frame.limit(80).collect()}
        assert sorted(got) == sorted((a, b) for a in asked for b in values if (a ^ b).bit_count() <= radius)


def test_query_runs_no_python(spark):
    got = QUERIES["op10_document_fingerprints"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    rows = got.collect()
    assert all((r.n_within_3 is not None) == (r.doc_id % 20 == 0) for r in rows)
    fps = [int(r.fingerprint, 16) for r in rows]
    for r in rows:
        if r.n_within_3 is not None:
            assert r.n_within_3 == sum((int(r.fingerprint, 16) ^ x).bit_count() <= 3 for x in fps)
