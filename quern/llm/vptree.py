"""Approximate nearest neighbours: a vantage-point tree per shard.

The largest inner product becomes the smallest distance by one more component that brings every
vector of the shard to the same norm (queries get zero there).  A tree splits a shard at the median
distance from a vantage point, down to leaves.  For a query, |d(query, vantage) - median| bounds the
distance to everything on the far side from below, by the triangle inequality; a leaf's bound is
the largest on its path.  Leaves are visited by ascending bound until `factor` times the bound
exceeds the k-th distance found.  Factor one never skips a nearer vector: the search is exact; a
larger factor visits fewer leaves.

Equal vectors of a shard are kept once, with their ids in order.  Defined cases: vectors that are
null, zero, of another length or not finite take no part, as queries or candidates; ties go to the
smaller id; a query never finds its own id; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, lean, row_count
from quern.llm.vectors import best_of, distinct_rows, shard_search, usable

#: Chosen on vectors that prune (clustered, of low rank, of uneven norm); the test embeddings, nearly as far
#: from each other as random ones, hardly prune and say little about it.
FACTOR = 1.5
LEAF = 256
#: Vectors to a shard, about: the first while that gives REGIONS regions at most, then more, up to the second.
SHARD_ROWS, MOST_ROWS = 16384, 1 << 17
#: Vectors that the upper levels are made of (or EACH for a region), and regions at most.
SAMPLE, EACH, REGIONS = 4096, 16, 4096


@dataclass
class Tree:
    points: np.ndarray  # original vectors, by leaf
    lifted: np.ndarray  # with the component that makes norms equal
    ids: np.ndarray
    ends: np.ndarray  # ids[ends[i]:ends[i+1]] belong to points[i]
    leaf_at: np.ndarray  # points[leaf_at[j]:leaf_at[j+1]] is leaf j
    vantage: np.ndarray
    median: np.ndarray
    paths: list[list[tuple[int, int]]]  # for each leaf: (node, side) with side 1 inside, -1 outside
    visits: int = 0  # leaves visited so far, over all queries


def build(ids: np.ndarray, matrix: np.ndarray, leaf: int = LEAF) -> Tree:
    first, grouped, ends = distinct_rows(ids, matrix)
    x = matrix[first]
    square = (x * x).sum(1)
    lifted = np.concatenate([x, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1)
    vantage, median, paths, leaves = [], [], [], []
    open_nodes: list[tuple[np.ndarray, list]] = [(np.arange(len(x)), [])]
    while open_nodes:
        rows, path = open_nodes.pop()
        if len(rows) > leaf:
            point = lifted[rows[len(rows) // 2]]
            d = np.sqrt(((lifted[rows] - point) ** 2).sum(1))
            m = float(np.median(d))
            inside = d <= m
            if inside.any() and not inside.all():
                node = len(vantage)
                vantage.append(point), median.append(m)
                open_nodes += [(rows[~inside], [*path, (node, -1)]), (rows[inside], [*path, (node, 1)])]
                continue
        leaves.append(rows), paths.append(path)
    order = np.concatenate(leaves)
    counts = np.diff(ends)[order]
    new_ends = np.concatenate([[0], np.cumsum(counts)])
    new_ids = grouped[np.repeat(ends[order] - new_ends[:-1], counts) + np.arange(len(grouped))]
    dim = lifted.shape[1]
    return Tree(np.ascontiguousarray(x[order]), lifted[order], new_ids, new_ends, np.concatenate([[0], np.cumsum([len(r) for r in leaves])]), np.array(vantage).reshape(-1, dim), np.array(median), paths)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int = 20, factor: float = FACTOR, least: np.ndarray | None = None):
    """(query row, id, score) of the k best for each query, by the largest inner product.  least: the
    score below which nothing is wanted any more, for each query."""
    n, leaves = len(queries), len(tree.paths)
    q = np.concatenate([queries, np.zeros((n, 1))], 1)
    bound = np.zeros((n, leaves))
    if len(tree.vantage):
        d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (tree.vantage**2).sum(1) - 2 * q @ tree.vantage.T, 0))
        for j, path in enumerate(tree.paths):
            for node, side in path:
                np.maximum(bound[:, j], side * (d[:, node] - tree.median[node]), out=bound[:, j])
    visit = np.argsort(bound, 1, kind="stable")
    want = k + 1  # the query's own vector may be among them
    near = np.full((n, want), np.inf)  # squared distances of the nearest distinct vectors
    at = np.full((n, want), -1)
    kth = np.full(n, np.inf)
    square, head = (tree.lifted**2).sum(1), tree.ids[tree.ends[:-1]]
    q2 = (q * q).sum(1)
    if least is not None and len(square):
        kth = np.maximum(q2 + square.max() - 2 * least, 0)
    live = np.arange(n)
    for step in range(leaves):
        b = bound[live, visit[live, step]]
        live = live[factor * b <= np.sqrt(kth[live]) + 1e-9]
        if not len(live):
            break
        goes = visit[live, step]
        tree.visits += len(live)
        for j in np.unique(goes):
            who = live[goes == j]
            a, z = tree.leaf_at[j], tree.leaf_at[j + 1]
            dist = np.maximum(q2[who, None] + square[a:z] - 2 * q[who] @ tree.lifted[a:z].T, 0)
            all_d = np.concatenate([near[who], dist], 1)
            all_at = np.concatenate([at[who], np.broadcast_to(np.arange(a, z), dist.shape)], 1)
            pick = np.argpartition(all_d, want - 1, 1)[:, :want]
            last = np.take_along_axis(all_d, pick, 1).max(1)
            tied = (all_d <= last[:, None] * (1 + 1e-12)).sum(1) > want
            tied &= np.isfinite(last)
            if tied.any():  # ties go by the first id of a vector
                order = np.lexsort((head[all_at[tied]], np.round(all_d[tied], 11)), 1)
                pick[tied] = order[:, :want]
            near[who], at[who] = np.take_along_axis(all_d, pick, 1), np.take_along_axis(all_at, pick, 1)
            kth[who] = np.minimum(kth[who], last)
    rows, points = np.nonzero(at >= 0)
    points = at[rows, points]
    score = (queries[rows] * tree.points[points]).sum(1)
    count = np.minimum(np.diff(tree.ends)[points], want)
    rows, score = np.repeat(rows, count), np.repeat(score, count)
    total = np.cumsum(count)
    found = tree.ids[np.repeat(tree.ends[points] - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)]
    on = found != query_ids[rows]
    rows, found, score = rows[on], found[on], score[on]
    order = np.lexsort((found, -score, rows))
    rows, found, score = rows[order], found[order], score[order]
    on = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[on], found[on], score[on]


@dataclass
class Top:
    """The upper levels of one tree over all vectors; its leaves are regions."""

    vantage: np.ndarray
    median: np.ndarray
    children: list[tuple[int, int]]  # for each node, inside and outside: a node, or -1 - region
    paths: list[list[tuple[int, int]]]  # for each region: (node, side)

    def region(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(0 if self.children else -1, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            inside = np.sqrt(((points[rows] - self.vantage[node]) ** 2).sum(1)) <= self.median[node]
            todo += [(self.children[node][0], rows[inside]), (self.children[node][1], rows[~inside])]
        return out

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """How near a region's vectors can be to each point at the least."""
        out = np.zeros((len(points), len(self.paths)))
        away = [np.sqrt(((points - v) ** 2).sum(1)) - m for v, m in zip(self.vantage, self.median)]  # once for each vantage point
        for j, path in enumerate(self.paths):
            for node, side in path:
                np.maximum(out[:, j], side * away[node], out=out[:, j])
        return out


def top_levels(points: np.ndarray, regions: int) -> Top:
    """Splits a sample at medians, the largest part first, until there are `regions` parts."""
    vantage, median, children, parts = [], [], [], [(np.arange(len(points)), [], None)]
    done: list[tuple[np.ndarray, list, tuple | None]] = []
    while parts and len(parts) + len(done) < regions:
        parts.sort(key=lambda p: len(p[0]))
        rows, path, parent = parts.pop()
        d = np.sqrt(((points[rows] - points[rows[0]]) ** 2).sum(1)) if len(rows) else np.zeros(0)
        m = float(np.median(d)) if len(d) else 0.0
        inside = d <= m
        if len(rows) < 4 or inside.all():
            done.append((rows, path, parent))
            continue
        node = len(vantage)
        vantage.append(points[rows[0]]), median.append(m), children.append([0, 0])
        if parent:
            children[parent[0]][parent[1]] = node
        parts += [(rows[inside], [*path, (node, 1)], (node, 0)), (rows[~inside], [*path, (node, -1)], (node, 1))]
    for region, (_, _, parent) in enumerate(parts + done):
        if parent:
            children[parent[0]][parent[1]] = -1 - region
    return Top(np.array(vantage).reshape(-1, points.shape[1]), np.array(median), [tuple(c) for c in children], [p for _, p, _ in parts + done])


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, visited: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k
    nearest among all other rows.

    Vectors are dealt to regions by the upper levels of one tree, made of a sample, as many regions as
    there are shards of `shard_rows` to fill.  Regions grow before they are cut: up to REGIONS * MOST_ROWS, half
    a thousand million vectors, more vectors make more and larger regions; what is larger still, as many equal
    vectors, is cut by the hash of the id.  A query first asks its nearest
    region; its k-th distance there then says which other regions can hold anything nearer, by the
    same bound, relaxed by the same factor, and only these are asked.  `visited`, if given, gets how many
    shards were asked and how many there were for all queries."""
    keep = Scratch()
    data = keep(usable(vectors, id_col, vec_col), "vp-vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    n, most = data.agg(F.count(F.lit(1)), F.max(square)).first()
    if not n:
        return keep.result(data.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")), "vp-result")
    shard_rows = max(shard_rows, min(-(-n // REGIONS), MOST_ROWS))
    regions = min(REGIONS, -(-n // shard_rows))
    most_rows = max(SAMPLE, EACH * regions)
    chance = min(1.0, most_rows / n)  # some so many rows of all tasks together
    sample = data.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.lit(int(chance * (1 << 30)))).select("vec").limit(4 * most_rows).collect()
    lift = lambda x: np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))[:, None]], 1)
    flat = lambda x: np.concatenate([x, np.zeros((len(x), 1))], 1)
    dim = len((sample[0] if sample else data.first())["vec"])
    top = top_levels(lift(np.array([r["vec"] for r in sample], np.float64).reshape(-1, dim)), regions)
    matrix = lambda b, c: b.column(c).flatten().to_numpy().reshape(b.num_rows, -1)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b, 1)
                home = np.zeros(b.num_rows, np.int64)
                asks = np.flatnonzero(b.column(0).to_numpy() % every == 0)
                home[asks] = top.bounds(flat(x[asks])).argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top.region(lift(x))), pa.array(home.astype(np.int32))], names=["id", "vec", "region", "home"])

    data = keep(data.mapInArrow(lean(assign), "id long, vec array<double>, region int, home int"), "vp-regions")
    sizes = {r["region"]: r["count"] for r in data.groupBy("region").count().collect()}  # REGIONS rows at most
    cuts = np.array([max(1, -(-sizes.get(j, 0) // shard_rows)) for j in range(len(top.paths))])
    base, shards = np.cumsum(cuts) - cuts, int(cuts.sum())
    at = lambda values, c: F.element_at(F.array(*[F.lit(int(v)) for v in values]), c + 1)
    region = F.col("region")
    rows = data.select((at(base, region) + F.pmod(F.xxhash64("id"), at(cuts, region).cast("long"))).cast("int").alias("shard"), "id", "vec")
    queries = data.where(F.col("id") % every == 0)
    spread = lambda df: df.select(F.explode(F.sequence(at(base, region), at(base, region) + at(cuts, region) - 1)).alias("shard"), "id", "vec", "least")
    ask = lambda asked: shard_search(rows, asked, shards, build, lambda t, i, q, least: search(t, i, q, k, factor, least), k, False)
    first = spread(queries.select(F.col("home").alias("region"), "id", "vec", F.lit(float("-inf")).alias("least")))
    near = keep(ask(first), "vp-near")
    last = best_of(near, k, False).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("last"))

    def reached(batches):
        for b in batches:
            if b.num_rows:
                x, home, last = matrix(b, 1), b.column(2).to_numpy(), b.column(3).fill_null(-np.inf).to_numpy()
                reach = np.sqrt(np.maximum((x * x).sum(1) + most - 2 * last, 0))
                on = factor * top.bounds(flat(x)) <= reach[:, None] + 1e-9
                on[np.arange(len(x)), home] = False
                row, to = np.nonzero(on)
                some = b.select([0, 1]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *some.columns, pa.array(last[row])], names=["region", "id", "vec", "least"])

    others = queries.select("id", "vec", "home").join(last, "id", "left").mapInArrow(lean(reached), "region int, id long, vec array<double>, least double")
    others = keep(spread(others), "vp-asked")
    if visited is not None:
        visited += [row_count(first) + row_count(others), row_count(queries) * shards]
    found = best_of(near.unionByName(ask(others)), k, False)
    return keep.result(found.select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "vp-result")
