"""Vectors dealt into shards, queries brought to shards, and the best of all shards."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import lean

QUERY_BLOCK = 1024


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): vectors that are not null, not zero, of the most frequent length, and hold finite
    components only; rows without an id go too, and repeated rows count once.  Each id has one vector:
    where usable ones differ, the smallest in order of components."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    df = df.where(F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0))
    df = df.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    each = df.groupBy("id", F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    found = each.groupBy("n").agg(F.count(F.lit(1)).alias("ids"), F.max("rows").alias("rows")).orderBy(F.desc("ids"), "n").first()
    df = df.where(F.size("vec") == F.lit(found["n"] if found else 0))
    if not found or found["rows"] == 1:  # no id is repeated: no vector need be moved
        return df
    return df.groupBy("id").agg(F.min("vec").alias("vec"))


def everywhere(data: DataFrame, is_query: Column, shards: int) -> DataFrame:
    """(shard, id, vec, least): each query, for each shard."""
    return data.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "vec", F.lit(float("-inf")).alias("least"))


def shard_search(rows: DataFrame, asked: DataFrame, shards: int, build: Callable, search: Callable, k: int, ascending: bool) -> DataFrame:
    """(query_id, ids, scores): the k best that each shard asked has for a query, packed.

    rows: (shard, id, vec), every vector in one shard; asked: (shard, id, vec, least), the queries each
    shard is to answer, with the score that is still wanted.  build(ids, matrix) makes a shard's index;
    search(index, query_ids, queries, least) gives arrays (query row, id, score) of the k best there.  A task holds one shard, and
    QUERY_BLOCK queries at a time."""
    held_rows = rows.select("shard", F.lit(0).alias("kind"), "id", "vec", F.lit(None).cast("double").alias("least"))
    both = held_rows.unionByName(asked.select("shard", F.lit(1).alias("kind"), "id", "vec", "least")).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "id")

    def run(batches):
        now, kind_now, parts, index = None, None, [], None

        def gathered():
            ids = np.concatenate([p.column(2).to_numpy() for p in parts])
            vecs = np.concatenate([p.column(3).flatten().to_numpy() for p in parts]).reshape(len(ids), -1)
            return ids, vecs

        def answers():
            ids, q = gathered()
            row, found, score = search(index, ids, q, np.concatenate([p.column(4).to_numpy(zero_copy_only=False) for p in parts]))
            ends = np.searchsorted(row, np.arange(len(ids) + 1))
            out = [(int(i), found[a:z].astype(np.int64).tobytes(), score[a:z].astype(np.float64).tobytes()) for i, a, z in zip(ids, ends[:-1], ends[1:]) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["query_id", "ids", "scores"])

        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            for a, z in zip(cut[:-1], cut[1:]):
                shard, kind = divmod(int(key[a]), 2)
                if (shard, kind) != (now, kind_now):
                    if kind_now == 1 and parts and index is not None:
                        yield answers()
                    if kind == 1:
                        index = build(*gathered()) if parts and now == shard else None
                    now, kind_now, parts = shard, kind, []
                while a < z:
                    room = QUERY_BLOCK - sum(p.num_rows for p in parts) if kind == 1 else z - a
                    parts.append(b.slice(a, min(room, z - a)))
                    a += min(room, z - a)
                    if kind == 1 and sum(p.num_rows for p in parts) >= QUERY_BLOCK:
                        if index is not None:
                            yield answers()
                        parts = []
        if kind_now == 1 and parts and index is not None:
            yield answers()

    return both.mapInArrow(lean(run), "query_id long, ids binary, scores binary")


def best_of(answers: DataFrame, k: int, ascending: bool) -> DataFrame:
    """(query_id, rank, id, score): the k best of all shards' answers; each is folded in as it comes."""

    def merge(batches):
        left = None  # what the last query of a batch has so far

        def chosen(q, i, s, whole):
            order = np.lexsort((i, s if ascending else -s, q))
            q, i, s = q[order], i[order], s[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q, "left") + 1
            on = rank <= k
            q, i, s, rank = q[on], i[on], s[on], rank[on]
            rest = q == q[-1] if not whole and len(q) else np.zeros(len(q), bool)
            done = pa.RecordBatch.from_arrays([pa.array(q[~rest]), pa.array(rank[~rest].astype(np.int32)), pa.array(i[~rest]), pa.array(s[~rest])], names=["query_id", "rank", "id", "score"])
            return done, (q[rest], i[rest], s[rest])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                ids = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
                q = np.repeat(b.column(0).to_numpy(), [len(x) for x in ids])
                i, s = np.concatenate(ids), np.concatenate([np.frombuffer(x, np.float64) for x in b.column(2).to_pylist()])
                if left is not None:
                    q, i, s = (np.concatenate(x) for x in zip(left, (q, i, s)))
                done, left = chosen(q, i, s, False)
                yield done
        if left is not None:
            yield chosen(*left, True)[0]

    return answers.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lean(merge), "query_id long, rank int, id long, score double")


def distinct_rows(ids: np.ndarray, matrix: np.ndarray):
    """(first row of each distinct vector, ids by vector, ends): ids ascend within a vector."""
    raw = np.ascontiguousarray(matrix + 0.0).view(np.dtype((np.void, matrix.shape[1] * matrix.itemsize))).ravel()
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    order = np.lexsort((ids, inverse))
    ends = np.searchsorted(inverse[order], np.arange(len(first) + 1))
    return first, ids[order], ends
