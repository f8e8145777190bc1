"""An inverted file of vectors that is kept: cells around centroids, stored apart, read only where asked.

Vectors are dealt to the cell of the nearest centroid by cosine, and written in a folder for each cell, so a
search prunes all cells that no query probes before a file is opened.  Centroids are trained on a
bounded sample (SAMPLE rows for each cell); every vector is indexed.  A cell with very many vectors, a
third of all for instance, is spread over several files by the rebalancing of the write.

What probing some cells finds of the true nearest is measured, not assumed: calibrate() compares with the
exact search for a bounded set of queries and keeps the least number of probes that reaches the recall
asked for.  Probing all cells is exact."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import retrieval

#: Cells at most, sampled vectors for each of them, and the bytes that the centroids may take in a task.
MAX_CELLS, SAMPLE, CENTROID_BYTES = 1 << 14, 64, 64 << 20
COLUMNS = ("node_id", "modality", "embedding")


def _usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    return vectors.where(e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x)))


def _units(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def trained(vectors: DataFrame, dim: int, cells: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Unit centroids, `cells` at most, from a sample of SAMPLE vectors for each."""
    n = vectors.count()
    share = min(1.0, cells * SAMPLE / max(1, n))
    rows = vectors.where(F.pmod(F.xxhash64("node_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = rows.where(F.exists("embedding", lambda x: x != 0)).select(array_to_vector("embedding").alias("features"))
    if rows.isEmpty():
        return np.zeros((1, dim))
    if cells == 1:
        return np.zeros((1, dim))
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=rounds, seed=seed).fit(rows)
    return _units(np.array(model.clusterCenters()))


@dataclass
class VectorIndex:
    """Centroids in `centers`, vectors in `vectors/cell=...`, settings in `about`, all under one path."""

    spark: SparkSession
    path: str

    def build(self, vectors: DataFrame, cells: int | None = None) -> VectorIndex:
        """Index all vectors (node_id, modality, embedding, more columns) that have one length and no null or NaN
        components; others are left out.  cells: the square root of the number of vectors where
        none is given."""
        rows = _usable(vectors)
        length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = length["n"] if length else 0
        rows = rows.where(F.size("embedding") == dim)
        most = max(1, min(MAX_CELLS, CENTROID_BYTES // max(1, 8 * dim)))
        centers = trained(rows, dim, max(1, min(most, cells or int(rows.count() ** 0.5))))
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "cell"]
        names = [f.name for f in rows.schema if f.name != "cell"]

        def dealt(batches):
            for b in batches:
                e = b.column(names.index("embedding")).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dim)
                cell = np.argmax(_units(e) @ centers.T, 1) if centers.shape[1] == dim else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=[*names, "cell"])

        held = rows.select(*names).mapInArrow(dealt, ", ".join([*kinds, "cell int"])).hint("rebalance", "cell")
        held.write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/vectors")
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centers")
        self._note({"dim": dim, "cells": len(centers), "probes": None, "columns": kinds})
        return self

    def _note(self, about: dict) -> None:
        self.spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/about")

    def about(self) -> dict:
        return json.loads(self.spark.read.parquet(f"{self.path}/about").first()[0])

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(", ".join([*self.about()["columns"], "cell int"])).parquet(f"{self.path}/vectors")

    def centers(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centers").collect()  # MAX_CELLS and CENTROID_BYTES bound them
        return np.array([r["center"] for r in sorted(rows, key=lambda r: r["cell"])], np.float64)

    def search(self, queries: DataFrame, limits: dict[str | None, int], probes: int | None = None, rows: DataFrame | None = None) -> DataFrame:
        """retrieval.nearest over the `probes` nearest cells of each query; all where neither it nor a
        calibration says how many.  rows: vectors() as the caller has narrowed them down."""
        about, centers = self.about(), self.centers()
        n = min(len(centers), probes or about["probes"] or len(centers))

        def cells(matrix: np.ndarray) -> dict[int, np.ndarray]:
            if matrix.shape[1] != centers.shape[1]:
                return {}
            near = np.argsort(-np.nan_to_num(_units(matrix) @ centers.T), 1, kind="stable")[:, :n]
            which, cell = np.repeat(np.arange(len(matrix)), n), near.ravel()
            return {int(c): which[cell == c] for c in np.unique(cell)}

        return retrieval.nearest(self.vectors() if rows is None else rows, queries, limits, cells)

    def recall(self, queries: DataFrame, k: int, probes: int, exact: DataFrame | None = None) -> float:
        """The share of the true k nearest of all queries that so many probes find."""
        want = exact if exact is not None else self.search(queries, {None: k}, self.about()["cells"])
        found = self.search(queries, {None: k}, probes)
        n = want.count()
        return want.join(found.select("query_id", "node_id"), ["query_id", "node_id"], "left_semi").count() / n if n else 1.0

    def calibrate(self, recall: float = 0.9, k: int = 10, queries: int = 100) -> float:
        """Keep the least number of probes that finds `recall` of the true k nearest, measured with
        `queries` indexed vectors; returns what was measured.  The number is doubled till it is enough, then narrowed."""
        about = self.about()
        picked = self.vectors().select("node_id", "embedding").orderBy(F.xxhash64("node_id"), "node_id").limit(queries)
        asked = self.spark.createDataFrame([(i, [float(x) for x in r["embedding"]]) for i, r in enumerate(picked.collect())], "query_id int, vector array<double>")
        exact = self.spark.createDataFrame(self.search(asked, {None: k}, about["cells"]).collect(), f"query_id int, node_id {self.vectors().schema['node_id'].dataType.simpleString()}, modality string, score double")  # queries * k rows
        measured: dict[int, float] = {}

        def enough(n: int) -> bool:
            measured[n] = self.recall(asked, k, n, exact)
            return measured[n] >= recall

        high = 1
        while not enough(high) and high < about["cells"]:
            high = min(about["cells"], 2 * high)
        low = high // 2
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid) else (mid, high)
        self._note(about | {"probes": high})
        return measured[high]
