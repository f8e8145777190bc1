"""The store's commits, merges, pinned readers, and its vector index."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import schema
from quern.config import StoreConfig
from quern.operators import retrieval
from quern.sources import commits, store, vector_index


def batch(spark, pages, mark, dim=4, seed=0):
    """Three nodes for each page, with vectors."""
    rng = np.random.default_rng([seed, *map(ord, mark)])
    rows = [(f"{p}-{i}", p, "text", "chunk", mark, f"{p}-0" if i else None, [float(x) for x in rng.normal(size=dim)]) for p in pages for i in range(3)]
    df = spark.createDataFrame(rows, "node_id string, page_id string, kind string, type string, title string, parent_id string, embedding array<float>")
    full = [(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.NODE_SCHEMA]
    return df.select(*full, "embedding")


def marks(graph):
    return {r.page_id: r.title for r in graph.nodes().select("page_id", "title").distinct().collect()}


@pytest.fixture
def graph(spark, tmp_path):
    return store.GraphStore(spark, StoreConfig(path=str(tmp_path / "g")))


def test_writers_at_once_lose_nothing(spark, graph):
    """Each writer has pages of its own and one that all write; the last entry of the log has that one."""
    wrong, entries = [], {}

    def write(k):
        try:
            own = store.GraphStore(spark, graph.config)
            entries[k] = own.store(batch(spark, [f"own{k}", "all"], f"m{k}"))
        except Exception as error:
            wrong.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not wrong and sorted(entries.values()) == [1, 2, 3, 4]
    got = marks(graph)
    assert got == {**{f"own{k}": f"m{k}" for k in range(4)}, "all": f"m{max(entries, key=entries.get)}"}
    assert graph.nodes().count() == 15 and graph.vectors().count() == 15 and graph.edges().count() == 10


def test_a_claimed_number_is_not_given_again(spark, tmp_path):
    path = str(tmp_path / "log")
    a, b = commits.CommitLog(spark, path), commits.CommitLog(spark, path)
    assert commits.put_if_absent(spark, f"{path}/000000000001.json", '{"batch": "x", "rows": 1, "replaces": []}')
    assert not commits.put_if_absent(spark, f"{path}/000000000001.json", "{}")
    assert a.last() == 1 and b.commit("y", 1) == 2 and a.commit("z", 1) == 3
    assert a.commit("xy", 2, ("x", "y")) == 4
    assert [x.batch for x in b.state()] == ["xy", "z"] and [x.batch for x in b.state(3)] == ["x", "y", "z"]
    with pytest.raises(commits.Outdated):
        b.commit("yz", 2, ("y", "z"))


def test_small_batches_are_merged_and_pinned_readers_stay(spark, graph, monkeypatch):
    monkeypatch.setattr(store, "FAN", 3)
    graph.store(batch(spark, ["a", "b"], "first"))
    pinned = graph.pinned()
    for k in range(8):
        graph.store(batch(spark, [f"p{k}", "a"], f"m{k}"))
    assert len(graph.log.state()) <= 4 and marks(graph) == {"a": "m7", "b": "first", **{f"p{k}": f"m{k}" for k in range(8)}}
    assert marks(pinned) == {"a": "first", "b": "first"}
    graph.compact()
    assert len(graph.log.state()) == 1 and marks(graph)["a"] == "m7" and marks(pinned) == {"a": "first", "b": "first"}
    orphan = f"{graph.config.path}/pages/batch=orphan"
    spark.createDataFrame([("x",)], "page_id string").write.parquet(orphan)
    assert graph.vacuum() > 8 and marks(graph)["a"] == "m7" and store.exists(spark, orphan)
    files = [f for t in store.TABLES for f in spark.read.parquet(f"{graph.config.path}/{t}").inputFiles() if "orphan" not in f]
    assert len(files) <= 8


def test_scrolling_gives_the_sorted_whole(spark, graph, monkeypatch):
    """Pages of n, over several batches with pages that were stored again; each page reads few files."""
    monkeypatch.setattr(store, "FAN", 100)
    assert graph.scroll("wiki_text", 3)[0].collect() == []
    graph.store(batch(spark, [f"p{i:02d}" for i in range(20)], "one"))
    monkeypatch.setattr(store, "FILE_ROWS", 10)
    graph.store(batch(spark, [f"p{i:02d}" for i in range(5, 25)], "two"))
    graph.store(batch(spark, ["p03"], "three").where("node_id != 'p03-1'"))

    def whole(n):
        out, at, reads = [], None, []
        while True:
            page, at = graph.scroll("wiki_text", n, at)
            rows = page.collect()
            out += [(r.node_id, tuple(r.embedding)) for r in rows]
            reads.append(len(page.inputFiles()))
            assert len(rows) == n or at is None
            if at is None:
                return out, reads

    want = sorted((r.node_id, tuple(r.embedding)) for r in graph.vectors().collect())
    assert len(want) == 74
    for n in (7, 30, 74, 200):
        got, reads = whole(n)
        assert got == want
    graph.compact()
    got, reads = whole(5)
    assert got == want and max(reads) <= 2 and len(graph.vectors().inputFiles()) >= 7
    assert graph.scroll("wiki_image", 3)[0].collect() == [] and graph.scroll("wiki_text", 0)[1] is None


def test_a_thousand_commits_leave_few_batches():
    """The rule alone: sizes as they come, each run it names as one."""
    state, rewritten, n = [], 0, 0
    for _ in range(1000):
        n += 1
        state.append(commits.Live(f"b{n}", n, 3))
        while runs := commits.runs_to_merge(state, 8):
            for run in runs:
                rewritten += sum(x.rows for x in run)
                at = state.index(run[0])
                state[at : at + len(run)] = [commits.Live(f"m{n}-{at}", run[-1].order, sum(x.rows for x in run))]
    assert len(state) <= 8 * 5 and sum(x.rows for x in state) == 3000 and rewritten <= 3000 * 6
    crossing = [commits.Live(str(i), i, 5) for i in range(1, 17)]
    assert all(not (run[0].order <= 5 < run[-1].order) for run in commits.runs_to_merge(crossing, 4, 5))


def table(spark, x, modality=lambda i: "text"):
    return spark.createDataFrame([(f"n{i:05d}", modality(i), [float(v) for v in r]) for i, r in enumerate(x)], "node_id string, modality string, embedding array<float>")


def clustered(n=3000, dim=16, centers=30, seed=2):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centers, dim))[rng.integers(0, centers, n)] + 0.15 * rng.normal(size=(n, dim))


def test_index_reads_only_probed_cells_and_all_cells_are_exact(spark, tmp_path):
    x = clustered()
    v = table(spark, x, lambda i: "image" if i % 4 == 0 else "text")
    index = vector_index.VectorIndex(spark, str(tmp_path / "i")).build(v, cells=24)
    assert index.vectors().count() == len(x)
    q = spark.createDataFrame([(i, [float(a) for a in x[i * 31]]) for i in range(40)], "query_id int, vector array<double>")
    got = lambda df: sorted((r[0], r[1], round(r[3], 9)) for r in df.collect())
    for limits in ({None: 7}, {"text": 6, "image": 3}):
        assert got(index.search(q, limits, 24)) == got(retrieval.nearest(v, q, limits))
    measured = index.calibrate(0.9, 10)
    probes = index.about()["probes"]
    assert measured >= 0.9 and probes < 24 and index.recall(q, 10, probes) >= 0.85
    first = q.limit(1)
    want = got(index.search(first, {"text": 5}, 2))
    plan = index.search(first, {"text": 5}, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell#" in plan
    near = np.argsort(-(index.centers() @ x[0]) / np.linalg.norm(x[0]), kind="stable")[:2]
    for f in (tmp_path / "i" / "vectors").glob("cell=*/*.parquet"):
        if int(f.parent.name.split("=")[1]) not in near:
            f.write_bytes(b"not to be read")
    assert got(index.search(first, {"text": 5}, 2)) == want and len(want) == 5


def test_index_of_odd_tables(spark, tmp_path):
    """Nothing, one vector, vectors of length zero, a third of all alike, unusable ones, extra columns."""
    build = lambda df, name: vector_index.VectorIndex(spark, str(tmp_path / name)).build(df)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [1.0])], "query_id int, vector array<double>")
    none = table(spark, [[1.0, 2.0, 3.0]]).limit(0)
    assert build(none, "a").search(q, {None: 3}).collect() == []
    assert [r.node_id for r in build(table(spark, [[1.0, 2.0, 3.0]]), "b").search(q.limit(1), {None: 3}).collect()] == ["n00000"]
    assert build(table(spark, [[0.0] * 3] * 4), "c").search(q, {None: 3}).count() == 6
    rng = np.random.default_rng(1)
    x = [[1.0, 1.0, 1.0]] * 100 + rng.normal(size=(200, 3)).tolist()
    df = table(spark, x).withColumn("cell", F.lit("clash")).withColumn("query", F.lit(1))
    bad = spark.createDataFrame([("z1", "text", None), ("z2", "text", [1.0]), ("z3", "text", [None, 1.0, 1.0]), ("z4", "text", [float("nan")] * 3)], "node_id string, modality string, embedding array<float>")
    index = build(df.unionByName(bad, allowMissingColumns=True), "d")
    assert index.vectors().count() == 300
    got = sorted((r.query_id, r.node_id) for r in index.search(q.limit(2), {None: 5}).collect())
    assert got == sorted((r.query_id, r.node_id) for r in retrieval.nearest(table(spark, x), q.limit(2), {None: 5}).collect())


def test_store_searches_by_its_index_and_what_came_since(spark, graph, monkeypatch):
    monkeypatch.setattr(store, "FAN", 100)
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(5).normal(size=(6, 4)))], "query_id int, vector array<double>")
    got = lambda df: sorted((r.query_id, r.node_id, round(r.score, 9)) for r in df.collect())
    exact = lambda: got(retrieval.nearest(graph.vectors(), q, {"text": 5, "image": 2}))
    graph.store(batch(spark, [f"p{i}" for i in range(30)], "one"))
    assert got(graph.search(q, {"text": 5, "image": 2})) == exact()
    graph.build_index(cells=5)
    assert graph.indexed() == 1 and got(graph.search(q, {"text": 5, "image": 2})) == exact()
    graph.store(batch(spark, ["p3", "p4", "new"], "two"))
    graph.store(batch(spark, ["p4"], "three"))
    before = exact()
    assert got(graph.search(q, {"text": 5, "image": 2})) == before
    assert got(graph.text_first(q, 5)) == before
    graph.compact()
    assert graph.indexed() == 4 and got(graph.search(q, {"text": 5, "image": 2})) == before
