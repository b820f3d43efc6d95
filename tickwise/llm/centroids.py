"""Centroid clustering: k-means rounds whose assignment is the threshold algorithm.

Vectors are turned into integers (``floor(scale * x)``), so distances, sums and means are exact and reruns agree
whatever the partitioning. A vector finds its nearest centroid by the threshold algorithm: every dimension has
the list of centroid values in order; the lists are walked outward from the vector's own value, the nearer side
first, one step in all lists at a time. A centroid met for the first time gets its exact distance. The sum of the
squared frontier distances bounds every centroid not met yet; a vector is done when that sum strictly exceeds its
best exact distance, so a tie is still seen and goes to the smaller number.

How it runs: the kept vectors are written once to the shared folder and read once a round. A round sends one row per
task and centroid (count and componentwise sums, pre-aggregated in the task) through the shuffle; ``k`` rows reach the driver,
which holds the ``k`` centroids of ``dims`` integers. No other data passes it. A hot cluster costs no more than
others, since sums leave a task already added up.

Defined cases: vectors of another length, null, or with a null or non-finite component are left out; a null id is
assigned like any other (it comes last in the choice of initial centroids); repeated rows get a row each, equal
initial vectors make equal centroids of which the smaller number wins and the others stay empty and unchanged; fewer
vectors than ``k`` make fewer centroids; an empty table gives an empty result; other columns, whatever their
names, are dropped. A component of 2**24 or more in size after scaling is refused with an error, since a squared
distance over many of them leaves the range of a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwise.llm.common import slices, stored

LARGEST = 1 << 24  # of a scaled component: a distance over up to 2**13 dimensions fits a long
CELLS = 1 << 21    # numbers that an assignment step holds at a time


def prepared(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x array<int>): the vectors that are kept, as integers."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale).cast("int"))
                         .otherwise(F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more in size"))
                                    .cast("int")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where((F.size("v") == dims) & fine).select("vec_id", scaled.alias("x")))


def initial(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.orderBy(key.asc_nulls_last(), "x").limit(k).select("x").collect()  # k rows
    return np.array([r.x for r in top], np.int64)


class Lists:
    """The sorted centroid lists of every dimension, and the walk over them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k, dims = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable")
        far = np.int64(LARGEST) * 4  # beyond the ends of a list: never the nearer side while the other has entries
        edge = np.full((1, dims), far)
        self.values = np.concatenate([-edge, np.take_along_axis(centroids, order, 0), edge])
        self.ids = np.concatenate([np.zeros((1, dims), np.int64), order, np.zeros((1, dims), np.int64)])
        self.step = max(1, CELLS // (k * dims))  # vectors taken at a time

    def _exact(self, x: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return ((x[rows] - self.centroids[ids]) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of every row of ``x``."""
        found = [self._nearest(x[a:a + self.step]) for a in range(0, len(x), self.step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (n, dims), k = x.shape, len(self.centroids)
        high = np.empty((n, dims), np.int64)  # next entry at or above the value, in each list
        for d in range(dims):
            high[:, d] = np.searchsorted(self.values[1:-1, d], x[:, d], side="left") + 1
        low = high - 1
        unmet = np.iinfo(np.int64).max
        exact = np.full((n, k), unmet)
        best = np.full(n, unmet)
        dim = np.arange(dims)
        active = np.arange(n)
        for _ in range(k):
            xa, lo, hi = x[active], low[active], high[active]
            below, above = xa - self.values[lo, dim], self.values[hi, dim] - xa
            down = below <= above
            met = np.zeros((len(active), k), bool)
            met[np.arange(len(active))[:, None], self.ids[np.where(down, lo, hi), dim]] = True
            row, c = np.nonzero(met & (exact[active] == unmet))
            exact[active[row], c] = self._exact(xa, row, c)
            best[active] = exact[active].min(1)
            frontier = (np.where(down, below, above) ** 2).sum(1)
            low[active], high[active] = lo - down, hi + ~down
            active = active[frontier <= best[active]]
            if not len(active):
                break
        return exact.argmin(1), best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of ``rows(vec_id, x)``."""
    dims = centroids.shape[1]

    def run(batches):
        lists = Lists(centroids)
        for b in slices(batches, 4096):
            near, dist = lists.nearest(_matrix(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array(dist, pa.int64())],
                                             names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of what is nearest to each centroid; a centroid without any stays."""
    k, dims = centroids.shape

    def run(batches):
        lists = Lists(centroids)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in slices(batches, 4096):
            x = _matrix(b.column(0), dims)
            near, _ = lists.nearest(x)
            np.add.at(sums, near, x)
            counts += np.bincount(near, minlength=k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array(counts[held], pa.int64()),
             pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = rows.select("x").mapInArrow(run, "cluster int, n long, total array<long>")
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(dims)]).alias("total"))
    out = centroids.copy()
    for r in added.collect():  # k rows at most
        out[r.cluster] = [t // r.n for t in r.total]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
            id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), centroids): the assignment after ``rounds`` moves of the centroids."""
    rows = stored(prepared(vectors, id_col, vec_col, dims, scale), "vectors")
    centroids = initial(rows, k, seed)
    if not len(centroids):
        return rows.selectExpr("vec_id", "0 as cluster", "0L as distance"), centroids
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    return stored(assign(rows, centroids), "clusters"), centroids


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the inertia of its cluster and of all, and the SHA-256 of its centroid's components."""
    sums = dict(map(tuple, assigned.groupBy("cluster").agg(F.sum("distance")).collect()))  # k rows at most
    total = sum(sums.values())
    rows = [(i, sums[i], total, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest())
            for i in sorted(sums)]
    per = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per), "cluster").select(  # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
