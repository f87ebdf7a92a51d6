"""Centroid clustering: rounds of exact integer k-means whose nearest centroids are found by Orchard's search.

Every centroid has the list of the others, nearest first.  A vector walks the list of the closest centroid found so
far: when it meets a closer one it jumps to that one's list, it marks what it has measured, and it stops at the first
entry strictly beyond twice its current distance, since no centroid behind it can be nearer or as near.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

DIMS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors that walk the lists side by side.
_CHUNK = 4096
_MOST = 2**63 - 1
_LIMB = 32


# ---- integers --------------------------------------------------------------------------------------------------

def safe_size(dims: int) -> int:
    """Components of at most this size keep four times a squared distance within a 64-bit integer."""
    return 1 << ((60 - max(1, dims - 1).bit_length()) // 2 - 1)


def to_integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) for finite x, exact: 64-bit integers where distances fit them, else Python integers."""
    with np.errstate(over="ignore"):
        f = np.floor(x.astype(np.float64) * scale)
    if not f.size or np.abs(f).max() <= safe_size(x.shape[1]):
        return f.astype(np.int64)
    out = np.empty(x.shape, object)
    out[:] = [[int(v) * scale if abs(v) >= 2.0**53 else math.floor(v * scale) for v in row] for row in x.astype(np.float64).tolist()]
    return out


def _as_array(centroids: list, dims: int) -> np.ndarray:
    out = np.empty((len(centroids), dims), object)
    out[:] = centroids
    return out.astype(np.int64) if max((abs(v) for c in centroids for v in c), default=0) <= safe_size(dims) else out


def _square(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(-1)


# ---- Orchard's search ------------------------------------------------------------------------------------------

class Neighbours:
    """The centroids with, for each, the others by ascending distance (ties: smaller number)."""

    def __init__(self, centroids: list, dims: int = DIMS):
        self.c = _as_array(centroids, dims)
        k = len(centroids)
        between = np.array([[_square(self.c[i] - self.c[j]) for j in range(k)] for i in range(k)], self.c.dtype).reshape(k, k)
        order = [sorted((j for j in range(k) if j != i), key=lambda j, i=i: (between[i, j], j)) for i in range(k)]
        self.order = np.array(order, np.int64).reshape(k, k - 1)
        self.between = np.take_along_axis(between, self.order, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance) of each row, and how many distances were measured."""
        if x.dtype == object or self.c.dtype == object:
            x, c, between = x.astype(object), self.c.astype(object), self.between.astype(object)
        else:
            c, between = self.c, self.between
        n, k = len(x), len(c)
        best = np.zeros(n, np.int64)
        dist = _square(x - c[0])
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)
        measured = n
        live = np.arange(n) if k > 1 else np.arange(0)
        while len(live):
            here, place = best[live], at[live]
            on = (between[here, place] <= 4 * dist[live]).astype(bool)
            live, here, place = live[on], here[on], place[on]
            other = self.order[here, place]
            fresh = ~seen[live, other]
            seen[live, other] = True
            rows, cand = live[fresh], other[fresh]
            measured += len(rows)
            d = _square(x[rows] - c[cand])
            closer = ((d < dist[rows]) | ((d == dist[rows]) & (cand < best[rows]))).astype(bool)
            at[live] = place + 1
            jump = rows[closer]
            best[jump], dist[jump], at[jump] = cand[closer], d[closer], 0
            live = live[at[live] < k - 1]
        return best, dist, measured


# ---- rounds ----------------------------------------------------------------------------------------------------

def _vectors(batch: pa.RecordBatch, dims: int, scale: int):
    """Chunks (rows, integers) of a batch whose last column holds vectors of ``dims`` components."""
    for lo in range(0, batch.num_rows, _CHUNK):
        part = batch.slice(lo, _CHUNK)
        flat = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
        yield part, to_integers(flat.reshape(-1, dims), scale)


def _limbs(v: int):
    """A number of any size as (limb, value) with value * 2 ** (32 * limb) adding up to it, so that sums of limbs are exact."""
    i = 0
    while not -(1 << _LIMB) < v < 1 << _LIMB:
        yield i, v & ((1 << _LIMB) - 1)
        v >>= _LIMB
        i += 1
    yield i, v


def _sums(centroids: list, dims: int, scale: int):
    def run(batches):
        near = Neighbours(centroids, dims)
        total = [[0] * (dims + 1) for _ in centroids]
        for batch in batches:
            for _, x in _vectors(batch, dims, scale):
                cluster = near.nearest(x)[0]
                for c in np.unique(cluster).tolist():
                    own = x[cluster == c]
                    total[c] = [a + b for a, b in zip(total[c], [*own.sum(0).tolist(), len(own)])]
        out = [(c, j, i, v) for c, row in enumerate(total) if row[-1] for j, s in enumerate(row) for i, v in _limbs(s)]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                                         names=["c", "j", "limb", "v"])
    return run


def _assign(centroids: list, dims: int, scale: int):
    def run(batches):
        near = Neighbours(centroids, dims)
        for batch in batches:
            for part, x in _vectors(batch, dims, scale):
                cluster, dist, _ = near.nearest(x)
                dist = pa.array([min(int(d), _MOST) for d in dist.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster.astype(np.int32)), dist], names=["vec_id", "cluster", "distance"])
    return run


def _move(vectors: DataFrame, centroids: list, dims: int, scale: int) -> list:
    """One round: every non-empty centroid becomes floor(sum / count) of its vectors.  Tasks send a few numbers a
    cluster and component, which Spark adds up; the driver gets as many."""
    part = vectors.select("v").mapInArrow(_sums(centroids, dims, scale), "c int, j int, limb int, v long")
    got = part.groupBy("c", "j", "limb").agg(F.sum("v").alias("v")).collect()
    total = [[0] * (dims + 1) for _ in centroids]
    for r in got:
        total[r["c"]][r["j"]] += r["v"] << (_LIMB * r["limb"])
    return [[s // row[-1] for s in row[:-1]] if row[-1] else old for old, row in zip(centroids, total)]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id",
            vector_col: str = "embedding") -> tuple[DataFrame, list]:
    """(rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256), the final centroids).

    Vectors with exactly ``dims`` components, none null or non-finite, take part, each component as
    floor(scale * x).  The first centroids are the k vectors with the smallest sha256 of ``seed:id``; every round
    assigns all vectors to the nearest centroid (squared distance, ties to the smaller number) and moves the
    non-empty ones to the exact floor of the mean; at last all are assigned once more.

    Repeated rows count each; equal hashes (repeated ids) are ordered by vector, null ids come after all others.
    Fewer than k vectors give as many clusters; equal centroids leave the later one empty.  Sums are exact at any
    size; distances and inertias beyond a long are given as the largest long.  An empty table gives no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    whole = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = stage(vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")), "cluster-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), []
    centroids = to_integers(np.array([r["v"] for r in first], np.float64), scale).tolist()
    for _ in range(rounds):
        centroids = _move(kept, centroids, dims, scale)
    done = stage(kept.mapInArrow(_assign(centroids, dims, scale), "vec_id long, cluster int, distance long"), "cluster-rows")
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def by_cluster(values, kind):
        return F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)

    inertia = [min(sums.get(c, 0), _MOST) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return done.select(F.col("vec_id").alias(id_col), "cluster", "distance", by_cluster(inertia, "long").alias("cluster_inertia"),
                       F.lit(min(sum(sums.values()), _MOST)).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256")), centroids
