"""Exact top-k search over binary codes by incremental multi-index hashing (Norouzi et al., 2012).

A code is cut into segments with an index each.  If two codes are within r*m + a bits of
each other (m segments), some segment s <= a differs in at most r bits or some later one in at
most r - 1.  So segments are probed in turn at radius 0, then 1, ...; after segment a at radius r
everything within r*m + a is known, and a query is done when its k-th verified distance is no more
than that.  The result is exact, ties included (smaller id first).

Codes are the signs of all of a vector's components (positive: 1), held as words of 64 bits; a segment
lies in one word.  Only ids and words are dealt to shards, and queries go to them as words.  Equal codes of a shard are indexed once, with their ids in order.  Defined cases as
in vptree.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, lean, row_count
from quern.llm.vectors import best_of, everywhere, shard_search, usable

BITS = 64
#: Vectors to a shard: about the first while there are fewer shards than a shuffle has partitions, else the second.
SHARD_ROWS, MOST_ROWS = 16384, 1 << 19


def codes(matrix: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit codes of at most 64 components; the first is the highest bit."""
    n = matrix.shape[1]
    if n > BITS:
        raise ValueError(f"{n} components do not fit a code of {BITS} bits")
    bits = np.zeros((len(matrix), BITS), np.uint8)
    bits[:, :n] = matrix > 0
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def words(matrix: np.ndarray) -> np.ndarray:
    """A row of codes for each vector, one for every 64 components."""
    return np.stack([codes(matrix[:, a : a + BITS]) for a in range(0, matrix.shape[1], BITS)], 1)


def as_words(matrix: np.ndarray) -> np.ndarray:
    """words() of vectors, or what it made of them as it was shipped."""
    return matrix.view(np.uint64) if matrix.dtype == np.int64 else words(matrix)


def coded(data: DataFrame) -> DataFrame:
    """(id, vec) with the words of each vector in its place, as signed numbers."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                own = words(b.column(1).flatten().to_numpy().reshape(b.num_rows, -1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * own.shape[1], pa.int32()), pa.array(own.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "vec"])

    return data.select("id", "vec").mapInArrow(lean(run), "id long, vec array<long>")


@dataclass
class Index:
    code: np.ndarray  # distinct codes, by word
    ids: np.ndarray
    ends: np.ndarray
    at_word: list[int]
    shifts: list[int]
    widths: list[int]
    order: list[np.ndarray]  # rows by segment value
    start: list[np.ndarray]


def build(ids: np.ndarray, matrix: np.ndarray, segments: int | None = None) -> Index:
    code, inverse = np.unique(as_words(matrix), axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.lexsort((ids, inverse))
    ends = np.searchsorted(inverse[by], np.arange(len(code) + 1))
    m = segments or max(4, round(BITS / max(4.0, np.log2(max(2, len(code))))))
    edges = [BITS * j // m for j in range(m + 1)]
    at_word, shifts, widths, order, start = [], [], [], [], []
    for w, a, b in [(w, a, b) for w in range(code.shape[1]) for a, b in zip(edges[:-1], edges[1:])]:
        part = (code[:, w] >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        o = np.argsort(part, kind="stable")
        at_word.append(w), shifts.append(a), widths.append(b - a), order.append(o)
        start.append(np.searchsorted(part[o], np.arange((1 << (b - a)) + 1)))
    return Index(code, ids[by], ends, at_word, shifts, widths, order, start)


def masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


def search(index: Index, query_ids: np.ndarray, queries: np.ndarray, k: int = 10):
    """(query row, id, distance) of the k nearest ids for each query."""
    own = as_words(queries)
    n, m, want, far = len(own), len(index.shifts), k + 1, 1 << 30
    total_ids = int(index.ends[-1])
    # (distance, first id, row) of the nearest distinct codes so far, best first
    dist = np.full((n, want), far, np.int64)
    rows = np.full((n, want), -1, np.int64)
    live = np.arange(n)
    head = index.ids[index.ends[:-1]]
    size = np.minimum(np.diff(index.ends), want)
    for radius in range(max(index.widths) + 1):
        for j in range(m):
            if not len(live):
                break
            if radius <= index.widths[j]:
                part = ((own[live, index.at_word[j]] >> np.uint64(index.shifts[j])) & np.uint64((1 << index.widths[j]) - 1)).astype(np.int64)
                for at in range(0, len(live), max(1, 200_000 // max(1, len(masks(index.widths[j], radius))))):
                    step = max(1, 200_000 // max(1, len(masks(index.widths[j], radius))))
                    who = live[at : at + step]
                    probe = (part[at : at + step, None] ^ masks(index.widths[j], radius)[None, :]).ravel()
                    a = index.start[j][probe]
                    count = index.start[j][probe + 1] - a
                    total = np.cumsum(count)
                    if not len(total) or not total[-1]:
                        continue
                    found = index.order[j][np.repeat(a - (total - count), count) + np.arange(int(total[-1]))]
                    q = np.repeat(np.repeat(who, len(probe) // len(who)), count)
                    d = np.bitwise_count(own[q] ^ index.code[found]).sum(1, dtype=np.int64)
                    on = d <= dist[q, -1]
                    q, found, d = q[on], found[on], d[on]
                    touched = np.unique(q)
                    old_q = np.repeat(touched, want)
                    old_r, old_d = rows[touched].ravel(), dist[touched].ravel()
                    held = old_r >= 0
                    q, found, d = np.concatenate([q, old_q[held]]), np.concatenate([found, old_r[held]]), np.concatenate([d, old_d[held]])
                    key = np.lexsort((found, head[found], d, q))
                    q, found, d = q[key], found[key], d[key]
                    new = np.concatenate([[True], (q[1:] != q[:-1]) | (found[1:] != found[:-1])]) if len(q) else np.zeros(0, bool)
                    q, found, d = q[new], found[new], d[new]
                    rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
                    on = rank < want
                    rows[q[on], rank[on]], dist[q[on], rank[on]] = found[on], d[on]
            # the k-th verified distance, counting every id of a code (own id perhaps among them)
            ids_so_far = np.where(rows[live] >= 0, size[rows[live]], 0).cumsum(1)
            enough = ids_so_far >= min(want, total_ids)
            kth = np.where(enough.any(1), dist[live, np.argmax(enough, 1)], far)
            live = live[kth > radius * m + j]
    q, at = np.nonzero(rows >= 0)
    code_row = rows[q, at]
    d = dist[q, at]
    count = size[code_row]
    total = np.cumsum(count)
    found = index.ids[np.repeat(index.ends[code_row] - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)]
    q, d = np.repeat(q, count), np.repeat(d, count)
    on = found != query_ids[q]
    q, found, d = q[on], found[on], d[on]
    order = np.lexsort((found, d, q))
    q, found, d = q[order], found[order], d[order]
    on = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[on], found[on], d[on]


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, distance) for each row whose id is divisible by `every`.  Shards are by
    the hash of the id, each answers all queries."""
    keep = Scratch()
    data = keep(coded(usable(vectors, id_col, vec_col)), "mih-codes")
    n = row_count(data)
    shards = max(1, -(-n // MOST_ROWS), min(-(-n // shard_rows), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = data.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    answers = shard_search(rows, everywhere(data, F.col("id") % every == 0, shards), shards, build, lambda t, i, q, _: search(t, i, q, k), k, True)
    return keep.result(best_of(answers, k, True).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("int").alias("distance")), "mih-result")
