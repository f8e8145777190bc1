"""Centroid clustering: Lloyd rounds over integer vectors, the nearest centroid found by annulus search.

A vector at distance u from any one centroid has its nearest centroid within u, and by the triangle
inequality the norms of the two differ by u at most.  So the centroids are sorted by norm, the ends of
each vector's annulus, its own norm plus and minus u, are found by binary search, and only centroids
between them are compared (Hamerly and Drake, 2015).  u comes from the centroid that a few
coordinates single out: any choice gives an upper bound, so the result is exact, whatever it prunes.
Distances are whole numbers and ties go to the smaller number; ends are widened by more than rounding
can take off, so a centroid on the very edge is compared too.

A round is one pass over the vectors: each task sends one row of sums for each cluster it has seen,
these are added up, and k centroids of 64 numbers come to the driver.  Vectors are never shuffled.

Defined cases: vectors that are null, of another length, or hold null or non-finite components take no part,
nor do those with a component of 2^19 or more either way, as their distances do not fit a long; repeated rows
count as often as they stand there; a row without a vec_id is assigned like others, but starts no centroid;
with fewer than k vectors there are fewer centroids; without any the result is empty."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, lean

#: Components after scaling are below this, so that 64 squared differences fit a long.
LIMIT = 1 << 27
#: Vectors compared at a time, and coordinates that single out the first centroid.
ROWS, COARSE = 4096, 8


class Annuli:
    """Centroids sorted by norm, searched by annulus."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norm, kind="stable")
        self.norm = norm[self.order]
        self.axes = np.argsort(-centroids.astype(np.float64).var(0), kind="stable")[:COARSE]
        self.compared = self.total = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid."""
        parts = [self._block(x[i : i + ROWS]) for i in range(0, len(x), ROWS)]
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _squared(self, x: np.ndarray, number: np.ndarray | int) -> np.ndarray:
        d = x - self.centroids[number]
        return np.einsum("ij,ij->i", d, d)

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, few = x[:, self.axes].astype(np.float64), self.centroids[:, self.axes].astype(np.float64)
        who = np.argmin((few * few).sum(1) - 2 * small @ few.T, 1)
        best = self._squared(x, who)
        own, reach = np.sqrt((x.astype(np.float64) ** 2).sum(1)), np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (own + reach) + 1e-6
        low = np.searchsorted(self.norm, own - reach - slack, "left")
        high = np.searchsorted(self.norm, own + reach + slack, "right")
        for j in range(int(low.min()), int(high.max())):
            rows, number = np.flatnonzero((low <= j) & (j < high)), self.order[j]
            d = self._squared(x[rows], number)
            self.compared += len(rows)
            closer = (d < best[rows]) | ((d == best[rows]) & (number < who[rows]))
            best[rows[closer]], who[rows[closer]] = d[closer], number
        self.total += len(x) * len(self.order)
        return who.astype(np.int32), best


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, as floor(scale * x)."""
    v = F.col(f"`{vec_col}`")
    rows = df.where(v.isNotNull() & (F.size(v) == dim)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double") * scale).alias("x"))
    fine = F.forall("x", lambda x: F.coalesce((x >= -LIMIT) & (x < LIMIT), F.lit(False)))  # null and NaN are not in it
    return rows.where(fine).select("vec_id", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, their sums)}: one row for each cluster and task, then added up; k rows at most."""
    dim = centroids.shape[1]

    def run(batches):
        index = Annuli(centroids)
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            x = _matrix(b.column(0), dim)
            who, _ = index.nearest(x)
            count += np.bincount(who, minlength=len(count))
            order = np.argsort(who, kind="stable")
            seen, first = np.unique(who[order], return_index=True)
            if len(seen):
                total[seen] += np.add.reduceat(x[order], first, 0)
        own = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dim, pa.int32()), pa.array(total[own].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), lists], names=["cluster", "n", "s"])

    parts = vectors.select("v").mapInArrow(lean(run), "cluster int, n long, s array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dim)])
    return {r[0]: (r[1], list(r[2:])) for r in added.collect()}


def clusters(df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Centroids start as the k vectors of the smallest sha256 of `seed:vec_id`, in that order (of one
    vec_id, the smaller vector first).  Each of `rounds` rounds assigns all vectors and sets each centroid to
    the floor of its vectors' means; empty ones stay.  Then all are assigned once more."""
    spark, scratch = df.sparkSession, Scratch()
    vectors = scratch(whole_vectors(df, id_col, vec_col, dim, scale), "kmeans-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where("vec_id is not null").select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        for c, (n, s) in _sums(vectors, centroids).items():
            centroids[c] = [x // n for x in s]

    def run(batches):
        index = Annuli(centroids)
        for b in batches:
            who, distance = index.nearest(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = scratch.result(vectors.select("vec_id", "v").mapInArrow(lean(run), "vec_id long, cluster int, distance long"), "kmeans-found")
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows at most
    whole = sum(inertia.values())
    about = [(c, x, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, x in inertia.items()]
    each = spark.createDataFrame(about or [], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
