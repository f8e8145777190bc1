"""Filtered top-k by cosine, weighted rank fusion, parents, context."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern import schema
from quern.operators.chunking import dot

#: Queries are sent to the tasks in blocks of so many bytes; scores that a task computes at a time, and pairs that
#: it looks at again.
QUERY_BYTES, SCORES, PAIRS = 16 << 20, 1 << 22, 1 << 16
#: What a block product may be off by.
SLACK = 1e-9


def with_norm(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))


def modality_of(kind: Column) -> Column:
    return F.when(kind.isin(*schema.IMAGE_MODALITY), "image").otherwise("text")


class _Best:
    """The k best of each query so far: (query, score, id, modality), ties to the smaller node_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.held = k, np.full(queries, -np.inf), None

    def add(self, ids: pa.Array, modality: pa.Array, which: np.ndarray, scores: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """scores: one row for each id, one column for each query of `which`, as a block product gives them.
        That may differ in the last place for equal vectors, so what comes near the k best is scored
        once more by exact(rows, columns), which does not."""
        if self.k < 1 or not len(ids) or not len(which):
            return
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        kth = np.partition(scores, len(ids) - self.k, 0)[len(ids) - self.k] if len(ids) > self.k else np.full(len(which), -np.inf)
        row, column = np.nonzero((scores >= np.maximum(kth, self.least[which]) - SLACK) & (scores > -np.inf))
        for at in range(0, len(row), PAIRS):
            r, c = row[at : at + PAIRS], column[at : at + PAIRS]
            self._merge(pa.table({"query": pa.array(which[c], pa.int32()), "score": exact(r, c), "id": ids.take(pa.array(r)), "modality": modality.take(pa.array(r))}))

    def _merge(self, new: pa.Table) -> None:
        both = new if self.held is None else pa.concat_tables([self.held, new])
        both = both.sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        query = both.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query, "left")
        self.held = both.filter(pa.array(place < self.k))
        full = place == self.k - 1
        self.least[query[full]] = both.column("score").to_numpy()[full]


def _query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(query_ids, matrix) of all queries with a vector, QUERY_BYTES at a time; one length in a block."""
    ids, rows = [], []
    for r in queries.where("vector is not null").select("query_id", "vector").toLocalIterator():
        if rows and (len(r[1]) != len(rows[0]) or len(rows) * len(rows[0]) * 8 >= QUERY_BYTES):
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
        ids.append(r[0]), rows.append([np.nan if x is None else x for x in r[1]])
    if rows:
        yield ids, np.array(rows, np.float64)


def _search(vectors: DataFrame, ids: list, matrix: np.ndarray, limits: dict[str | None, int], asked: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(query, part, node_id, modality, score): the best that each task has of one block of queries; part is the
    place of the limit that they are within.

    limits: how many for each modality; None: of all together.  asked: the queries that look into a
    cell (column `cell`); without it each query looks at all vectors."""
    norms = np.sqrt((matrix * matrix).sum(1))

    def run(batches):
        best = {m: _Best(len(matrix), k) for m, k in limits.items()}
        name = {m: pa.array([m]) for m in limits}
        step = max(1, SCORES // max(1, len(matrix)))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                b = b.filter(pc.fill_null(pc.equal(pc.list_value_length(b.column("embedding")), matrix.shape[1]), False))
                e = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, matrix.shape[1])
                size = np.sqrt((e * e).sum(1))
                cell = b.column("cell").to_numpy() if asked is not None else np.zeros(b.num_rows, np.int32)
                for c in np.unique(cell).tolist():
                    which = np.arange(len(matrix)) if asked is None else asked.get(c, np.zeros(0, np.int64))
                    for m in limits:
                        rows = np.flatnonzero((cell == c) & (np.ones(b.num_rows, bool) if m is None else pc.fill_null(pc.equal(b.column("modality"), name[m][0]), False).to_numpy(zero_copy_only=False)))
                        own, asks = e[rows], matrix[which]
                        both = size[rows][:, None] * norms[which]
                        cosine = np.divide(own @ asks.T, both, out=np.zeros(both.shape), where=both != 0)

                        def exact(r, q, own=own, asks=asks, both=both):
                            n = both[r, q]
                            return np.divide(np.einsum("ij,ij->i", own[r], asks[q]), n, out=np.zeros(len(n)), where=n != 0)

                        best[m].add(b.column("node_id").take(pa.array(rows)), b.column("modality").take(pa.array(rows)), which, np.where(np.isnan(both), np.nan, cosine), exact)
        for part, found in enumerate(best.values()):
            for b in found.held.to_batches() if found.held is not None else ():
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), b.column(2), b.column(3), b.column(1)], names=["query", "part", "node_id", "modality", "score"])

    rows = vectors.select("node_id", "modality", "embedding", *(["cell"] if asked is not None else []))
    kind = vectors.schema["node_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"query int, part int, node_id {kind}, modality string, score double")


def nearest(vectors: DataFrame, queries: DataFrame, limits: dict[str | None, int], probes: Callable[[np.ndarray], dict[int, np.ndarray]] | None = None) -> DataFrame:
    """(query_id, node_id, modality, score): the nearest of each query by cosine, ties to the smaller
    node_id; `limits` says how many of each modality, {None: k} the k best of all.

    queries: (query_id, vector), which come to the driver in blocks of QUERY_BYTES; a block goes to all
    tasks, which multiply it with blocks of vectors and send on no more than what may be among the best.
    So a pass over the vectors serves a block, and no pair of query and vector is ever a row.  probes: for
    an index, which queries of a block look into which cell; only these cells are read.

    Vectors without an embedding, of another length than a query, or with null or NaN components score
    nothing; vectors and queries of length zero score 0."""
    spark, parts = vectors.sparkSession, []
    kind, own = queries.schema["query_id"].dataType, vectors.schema["node_id"].dataType.simpleString()
    for ids, matrix in _query_blocks(queries):
        rows, asked = vectors, None
        if probes is not None:
            asked = probes(matrix)
            rows = vectors.where(F.col("cell").isin(sorted(asked)))
        names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("query_id", kind)]))
        known = [m for m in limits if m is not None]
        found = _search(rows.where(F.col("modality").isin(known)) if len(known) == len(limits) else rows, ids, matrix, limits, asked)
        first = Window.partitionBy("query", "part").orderBy(F.desc("score"), "node_id")
        found = found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.element_at(F.array(*map(F.lit, limits.values())), F.col("part") + 1))
        parts.append(found.join(F.broadcast(names), "query").select("query_id", "node_id", "modality", "score"))
    if not parts:
        return spark.createDataFrame([], f"query_id {kind.simpleString()}, node_id {own}, modality string, score double")
    return reduce(DataFrame.unionByName, parts)


def best(hits: DataFrame, limits: dict[str | None, int]) -> DataFrame:
    """Of hits from several places those within the limits of nearest()."""
    if None in limits:
        return top_k(hits, limits[None])
    first = Window.partitionBy("query_id", "modality").orderBy(F.desc("score"), "node_id")
    limit = F.coalesce(*[F.when(F.col("modality") == m, F.lit(k)) for m, k in limits.items()])
    return hits.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit).drop("_r")


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; WindowGroupLimit keeps k a task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int, modality: str | None = None) -> DataFrame:
    return nearest(vectors, queries, {modality: k})


def text_first(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """k text hits and half as many image hits of each query, out of one pass over the vectors."""
    return nearest(vectors, queries, {"text": k, "image": k // 2})


def run_queries(vectors: DataFrame, queries: DataFrame, k: int = 10, search: Callable[..., DataFrame] = text_first) -> DataFrame:
    """text_first, or an index's, for all distinct queries; of equal texts the first counts."""
    if "text" in queries.columns:
        first = Window.partitionBy("text").orderBy("query_id")
        queries = queries.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    return search(vectors, queries, k)


def ranked(hits: DataFrame) -> DataFrame:
    """rank from 0 within each query, text and image together; ties: text first, then node_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("modality"), "node_id")
    return hits.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def fuse(hits: DataFrame, k: int = 10, constant: int = 60, boost: float = 1.5) -> DataFrame:
    """(node_id, modality, score): the k best by the sum of boost / (rank + constant), where text has
    the boost and images one; ties by the first query and rank that a node was seen at."""
    part = F.when(F.col("modality") == "text", F.lit(boost)).otherwise(F.lit(1.0)) / (F.col("rank") + F.lit(float(constant)))
    fused = ranked(hits).groupBy("node_id", "modality").agg(F.sum(part).alias("score"), F.min(F.struct("query_id", "rank")).alias("_seen"))
    return fused.orderBy(F.desc(F.round("score", 12)), "_seen", "node_id").limit(k)


def parents(hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rank, node...): the parents of ranked hits (node_id, rank) that are sections, subsections,
    images or plots, once each, by the first hit that leads there.  Hits are few (top-k)."""
    up = edges.where("rel = 'PARENT'").select("src_id", "dst_id")
    found = F.broadcast(hits.select(F.col("node_id").alias("dst_id"), "rank")).join(up, "dst_id").groupBy("src_id").agg(F.min("rank").alias("rank"))
    kept = nodes.where(F.col("type").isin(*schema.PARENT_TYPES))
    return kept.join(F.broadcast(found.withColumnRenamed("src_id", "node_id")), "node_id")


def context(parent_rows: DataFrame) -> DataFrame:
    """One row (texts, image_urls): non-empty texts and urls of the parents joined by a space, by rank."""
    joined = lambda c, on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on & (F.coalesce(F.col(c), F.lit("")) != ""), F.struct("rank", "node_id", c)))), lambda x: x[c]), " ")
    image = F.col("kind") == "image"
    return parent_rows.agg(joined("text", ~image).alias("texts"), joined("image_url", image).alias("image_urls"))


def lookup(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of a list of ids; missing ones are left out."""
    return nodes.join(ids.select("node_id").distinct(), "node_id")
