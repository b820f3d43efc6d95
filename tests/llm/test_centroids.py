"""Centroid clustering against all distances in plain integers."""

import hashlib
import math

import numpy as np
import pytest

from tickwise.llm import centroids as C


def plain_clusters(rows, k, rounds, dims, scale=64, seed=1):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)] if n in groups else c
                 for n, c in enumerate(cents)]
    return [(i, *near(v)[::-1]) for i, v in kept], cents


@pytest.mark.parametrize(("n", "k", "dims", "spread"), [(300, 16, 64, 100), (500, 7, 3, 4), (200, 1, 5, 9), (400, 30, 2, 3)])
def test_threshold_walk_equals_all_distances(n, k, dims, spread):
    rng = np.random.default_rng(n + k)
    cents, x = rng.integers(-spread, spread, (k, dims)), rng.integers(-2 * spread, 2 * spread, (n, dims))
    near, dist = C.Lists(cents).nearest(x)
    full = ((x[:, None] - cents[None]) ** 2).sum(2)
    assert (near == full.argmin(1)).all() and (dist == full.min(1)).all()  # argmin: the smaller number of a tie


def test_walk_stops_before_all_centroids_are_met(monkeypatch):
    cents = np.arange(0, 4000, 10)[:, None].repeat(4, 1)
    asked = []
    exact = C.Lists._exact
    monkeypatch.setattr(C.Lists, "_exact", lambda self, x, r, c: asked.extend(c) or exact(self, x, r, c))
    near, dist = C.Lists(cents).nearest(np.full((1, 4), 2003))
    assert near.tolist() == [200] and dist.tolist() == [36] and len(asked) < 6


ROWS = ([(i, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i in range(60)]
        + [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 2.0, 3.0]), (103, [float("nan"), 0.0, 0.0, 0.0]),
           (104, [float("inf"), 0.0, 0.0, 0.0]), (7, [0.5, 0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5, 0.5]),
           (None, [0.25, -0.25, 1.0, 2.0]), (105, [])])


def test_table(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "vec_id long, embedding array<float>, cluster string")
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in ROWS]
    for k, rounds in ((5, 3), (100, 1), (1, 2)):
        got, cents = C.cluster(df.repartition(4), k=k, rounds=rounds, dims=4)
        want, plain = plain_clusters(rows, k, rounds, 4)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
        assert cents.tolist() == plain
    none, _ = C.cluster(df.limit(0), dims=4)
    assert none.count() == 0 and C.described(none, _).count() == 0


def test_large_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="or more in size"):
        C.cluster(df, k=1, dims=2)


def test_query_equals_the_contract_in_plain_python(spark):
    from tickwise.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, cents = plain_clusters(rows, 16, 3, 64)
    inertia = sum(d for *_, d in want)
    per = {c: sum(d for _, x, d in want if x == c) for _, c, _ in want}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    got = QUERIES["op12_centroid_clustering"](spark, sf).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((i, c, d, per[c], inertia, sha[c]) for i, c, d in want)
