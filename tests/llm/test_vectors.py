import numpy as np
import pytest

from quern.llm import mih, vectors, vptree


def table(spark, n=700, dim=64, seed=0, hot=120):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * rng.uniform(0.5, 2, (n, 1))
    x[100 : 100 + hot] = x[100]
    rows = [(i, [float(np.float32(v)) for v in r], 1) for i, r in enumerate(x)]
    bad = [(1000, None, 1), (1020, [0.0] * dim, 1), (1040, [float("nan")] * dim, 1), (1060, [None] * dim, 1), (1080, [float("inf")] + [1.0] * (dim - 1), 1), (None, rows[3][1], 1)]
    return rows, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")


def exact(rows, every, k, score):
    out = []
    for q, v, _ in rows:
        if q % every == 0:
            best = sorted((score(v, w), i) for i, w, _ in rows if i != q)[:k]
            out += [(q, r + 1, i) for r, (_, i) in enumerate(best)]
    return sorted(out)


def test_factor_one_is_exact(spark):
    rows, df = table(spark)
    got = sorted((r[0], r[1], r[2]) for r in vptree.nearest(df, every=20, k=20, factor=1.0, shard_rows=200).collect())
    assert got == exact(rows, 20, 20, lambda a, b: -float((np.array(a) * np.array(b)).sum()))


def test_relaxed_factor_keeps_recall(spark):
    rows, df = table(spark, n=3000, hot=5)
    got = {(r[0], r[2]) for r in vptree.nearest(df, every=20, k=20).collect()}
    want = exact(rows, 20, 20, lambda a, b: -float(np.dot(a, b)))
    assert sum((q, i) in got for q, _, i in want) >= 0.9 * len(want)


def test_a_larger_factor_visits_fewer_leaves():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 1, 16)) + 0.05 * rng.normal(size=(20, 100, 16))
    x = x.reshape(-1, 16)
    x /= np.sqrt((x * x).sum(1))[:, None]
    truth = x[:50] @ x.T
    truth[np.arange(50), np.arange(50)] = -np.inf
    best = -np.sort(-truth, 1)[:, :5]
    visits = []
    for factor in (1.0, 1.5, 3.0):
        tree = vptree.build(np.arange(len(x)), x, leaf=16)
        row, _, score = vptree.search(tree, np.arange(50), x[:50], 5, factor)
        visits.append(tree.visits)
        if factor == 1.0:
            assert np.allclose(score.reshape(50, 5), best)
        if factor == 1.5:
            assert np.mean(score >= best[row, 4] - 1e-12) >= 0.9
    assert visits[0] > visits[1] > visits[2]


def pruning_vectors(kind, n=16384, dim=64):
    rng = np.random.default_rng(5)
    if kind == "clustered":
        x = rng.normal(size=(n // 64, 1, dim)) + 0.3 * rng.normal(size=(n // 64, 64, dim))
        x = x.reshape(-1, dim)
    else:
        x = rng.normal(size=(n, 8 if "8" in kind else 4)) @ rng.normal(size=(8 if "8" in kind else 4, dim))
    if "uneven" in kind:
        return x
    return x / np.sqrt((x * x).sum(1))[:, None]


@pytest.mark.parametrize("kind", ["clustered", "rank 4", "rank 8", "rank 8, uneven norms"])
def test_production_factor_keeps_recall_where_leaves_are_pruned(kind):
    x = pruning_vectors(kind)
    ids = np.arange(len(x))
    tree = vptree.build(ids, x)
    row, found, _ = vptree.search(tree, ids[:200], x[:200])
    truth = x[:200] @ x.T
    truth[ids[:200], ids[:200]] = -np.inf
    best = np.argsort(-truth, 1, kind="stable")[:, :20]
    assert tree.visits < 200 * len(tree.paths)
    assert np.mean([len(np.intersect1d(found[row == i], best[i])) / 20 for i in range(200)]) >= 0.98


def test_queries_skip_shards_that_hold_nothing_near(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(16, 1, 24)) * 4 + 0.2 * rng.normal(size=(16, 150, 24))
    x = x.reshape(-1, 24)[rng.permutation(2400)]
    x /= np.sqrt((x * x).sum(1))[:, None]
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    truth = x @ x.T
    np.fill_diagonal(truth, -np.inf)
    asked = []
    for factor in (1.0, vptree.FACTOR):
        visited = []
        got = vptree.nearest(df, every=20, k=20, factor=factor, shard_rows=150, visited=visited).collect()
        right = sum(r.score >= np.sort(truth[r.query_id])[-20] - 1e-9 for r in got)
        assert len(got) == 120 * 20 and right >= (1.0 if factor == 1 else 0.98) * len(got)
        asked.append(visited[0] / visited[1])
    assert asked[1] <= asked[0] < 0.5


def test_the_share_of_shards_asked_falls_as_the_table_grows(spark):
    """Clusters of one size, more and more of them: regions grow in number, and a query asks about as many."""
    shares = []
    for n in (1000, 10_000):
        rng = np.random.default_rng(3)
        x = (rng.normal(size=(n // 100, 1, 16)) * 3 + 0.2 * rng.normal(size=(n // 100, 100, 16))).reshape(-1, 16)
        x /= np.sqrt((x * x).sum(1))[:, None]
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
        visited = []
        got = vptree.nearest(df, every=20, k=20, shard_rows=200, visited=visited).collect()
        right = 0
        for q in range(0, n, 20):
            score = x @ x[q]
            score[q] = -np.inf
            right += sum(r.score >= np.sort(score)[-20] - 1e-9 for r in got if r.query_id == q)
        assert right >= 0.9 * len(got) and len(got) == n // 20 * 20
        shares.append(visited[0] / visited[1])
    assert shares[1] < 0.5 * shares[0]


def test_regions_cover_their_points():
    rng = np.random.default_rng(9)
    for points in (rng.normal(size=(500, 6)), np.zeros((50, 6)), rng.normal(size=(1, 6))):
        top = vptree.top_levels(points, 9)
        region, bound = top.region(points), top.bounds(points)
        assert region.max() < len(top.paths) <= 9 and np.allclose(bound[np.arange(len(points)), region], 0)
        for j in range(len(top.paths)):
            for i in range(0, len(points), 50):
                if (region == j).any():
                    assert np.sqrt(((points[region == j] - points[i]) ** 2).sum(1)).min() >= bound[i, j] - 1e-9


def test_large_regions_are_cut(spark):
    """Equal vectors can't be told apart by a tree: their shards are cut by id."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(1000 + i, [3.0, 2.0, float(i)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r[0], r[1], r[2]) for r in vptree.nearest(df, every=100, k=5, factor=1.0, shard_rows=60).collect())
    assert got == exact([(i, v, 1) for i, v in rows], 100, 5, lambda a, b: -float(np.dot(a, b)))


def test_hamming_top_k_is_exact(spark):
    rows, df = table(spark, n=500)
    got = sorted((r[0], r[1], r[2]) for r in mih.top_k(df, every=50, k=10, shard_rows=150).collect())
    assert got == exact(rows, 50, 10, lambda a, b: sum((x > 0) != (y > 0) for x, y in zip(a, b)))


def test_codes_are_dealt_not_vectors(spark):
    _, df = table(spark, n=300)
    sent = mih.coded(vectors.usable(df, "vec_id", "embedding"))
    assert dict(sent.dtypes) == {"id": "bigint", "vec": "array<bigint>"} and all(len(r.vec) == 1 for r in sent.collect())
    assert "Exchange" not in sent._jdf.queryExecution().toString()  # no id is repeated: nothing moves


@pytest.mark.parametrize("segments", [4, 8, 13])
def test_multi_index_against_a_scan(segments):
    rng = np.random.default_rng(segments)
    x = rng.normal(size=(900, 64))
    x[50:400] = x[50] * np.where(rng.random((350, 64)) < 0.03, -1, 1)
    ids = rng.permutation(900) + 7
    index = mih.build(ids, x, segments)
    q, found, d = mih.search(index, ids[:80], x[:80], 10)
    code = mih.codes(x)
    for i in range(80):
        dist = np.bitwise_count(code[i] ^ code)
        order = [j for j in np.lexsort((ids, dist)) if j != i][:10]
        assert list(zip(found[q == i], d[q == i])) == [(ids[j], dist[j]) for j in order]


def test_few_or_no_vectors(spark):
    _, df = table(spark)
    assert vptree.nearest(df.where("vec_id in (0, 1)")).count() == 1
    assert vptree.nearest(df.where("false")).count() == 0 and mih.top_k(df.where("false")).count() == 0
    assert mih.top_k(df.where("vec_id in (0, 5, 7)")).count() == 2


def test_repeated_rows_count_once(spark):
    rows, df = table(spark, n=300, hot=5)
    larger = [(i, [v[0] + 1.0, *v[1:]], 1) for i, v, _ in rows if i in (0, 7)]
    again = df.unionByName(df.where("vec_id in (0, 3, 100)")).unionByName(df.where("vec_id in (0, 3)")).unionByName(spark.createDataFrame(larger, df.schema))
    for search in (lambda t: vptree.nearest(t, every=50, k=20, factor=1.0, shard_rows=100), lambda t: mih.top_k(t, every=50, k=10, shard_rows=100)):
        want, got = (sorted(tuple(r)[:3] for r in search(t).collect()) for t in (df, again))
        assert got == want
    wide = spark.createDataFrame([(i, [1.0] * 65, 1) for i in range(200)] * 2, df.schema)  # more rows, fewer ids
    assert vectors.usable(again.unionByName(wide), "vec_id", "embedding").count() == 300


@pytest.mark.parametrize("dim", [65, 100, 200])
def test_codes_hold_every_component(dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(300, dim))
    x[:150, :64] = np.abs(x[:150, :64])  # alike but for what comes after 64 components
    ids = rng.permutation(300) + 7
    q, found, d = mih.search(mih.build(ids, x), ids[:40], x[:40], 10)
    for i in range(40):
        dist = ((x[i] > 0) != (x > 0)).sum(1)
        order = [j for j in np.lexsort((ids, dist)) if j != i][:10]
        assert list(zip(found[q == i], d[q == i])) == [(ids[j], dist[j]) for j in order]
