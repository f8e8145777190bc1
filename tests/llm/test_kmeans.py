import hashlib

import numpy as np
import pytest

from quern.llm import kmeans


def brute(rows, k=40, rounds=5, seed=2, dim=64):
    """Rows (vec_id, components) by plain loops; ids are there and differ."""
    own = {}
    for i, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v):
            own[i] = np.array([int(np.floor(256 * float(x))) for x in v], object)
    first = sorted(own, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]
    centroids = [own[i] for i in first]
    nearest = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = {i: nearest(v)[1] for i, v in own.items()}
        for j in set(found.values()):
            members = [own[i] for i in own if found[i] == j]
            centroids[j] = sum(members[1:], members[0]) // len(members)
    last = {i: nearest(v) for i, v in own.items()}
    whole = sum(d for d, _ in last.values())
    inside = {j: sum(d for d, c in last.values() if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, inside[j], whole, sha[j]) for i, (d, j) in last.items())


def frame(spark, rows):
    return spark.createDataFrame([([None if x is None else float(x) for x in v] if v is not None else None, i, "c") for i, v in rows], "embedding array<double>, vec_id long, cluster string").repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("kind", ["even", "clustered", "alike"])
def test_equals_plain_loops(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    if kind == "clustered":
        x = 0.05 * x + 3 * rng.normal(size=(12, 64))[rng.integers(0, 12, 300)] * rng.uniform(0.1, 3, (300, 1)).round()
    if kind == "alike":
        x[:200] = x[0]
    rows = [(int(i) * 7 - 3, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, [1.0] * 63), (5002, [None] + [1.0] * 63), (5003, [float("nan")] + [1.0] * 63), (5004, [float("-inf")] * 64), (5005, []), (5006, [1.0] * 65)]
    assert got(kmeans.clusters(frame(spark, rows + bad))) == brute(rows + bad)


def test_few_vectors_none_and_large_ones(spark):
    rows = [(1, [1.5] * 64), (2, [-2.25] * 64), (3, [400_000.0] * 32 + [-500_000.0] * 32)]
    assert got(kmeans.clusters(frame(spark, rows))) == brute(rows)
    assert got(kmeans.clusters(frame(spark, rows), k=1, rounds=2)) == brute(rows, 1, 2)
    assert got(kmeans.clusters(frame(spark, rows + [(4, [float(1 << 19)] * 64)]))) == brute(rows)
    assert kmeans.clusters(frame(spark, [(1, None)])).collect() == [] == kmeans.clusters(frame(spark, rows).limit(0)).collect()


def test_repeated_rows_and_rows_without_an_id(spark):
    rows = [(1, [1.0] * 64), (1, [1.0] * 64), (2, [9.0] * 64), (None, [8.0] * 64)]
    out = kmeans.clusters(frame(spark, rows), k=4, rounds=1).collect()
    assert len(out) == 4 and {r.cluster for r in out if r.vec_id == 1} == {min(r.cluster for r in out if r.vec_id == 1)}
    lone = next(r for r in out if r.vec_id is None)
    assert lone.cluster == next(r.cluster for r in out if r.vec_id == 2)
    assert kmeans.clusters(frame(spark, [(None, [8.0] * 64)])).collect() == []


def test_annuli_prune_and_stay_exact():
    rng = np.random.default_rng(6)
    centroids = (rng.normal(size=(60, 64)) * np.linspace(50, 4000, 60)[:, None]).astype(np.int64)
    centroids[10] = centroids[30]
    x = np.concatenate([c + rng.integers(-40, 40, (50, 64)) for c in centroids])
    index = kmeans.Annuli(centroids)
    who, distance = index.nearest(x)
    all_ = ((x[:, None, :] - centroids) ** 2).sum(2)
    assert (who == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert index.compared < 0.3 * index.total


def test_a_centroid_on_the_edge_of_the_annulus_wins_a_tie():
    """Two centroids at the same distance, on opposite ends of the annulus: the smaller number."""
    centroids = np.zeros((3, 64), np.int64)
    centroids[0, 0], centroids[1, 0], centroids[2, 1] = 30, 10, 500
    x = np.zeros((1, 64), np.int64)
    x[0, 0] = 20
    for order in ([0, 1, 2], [1, 0, 2], [2, 1, 0]):
        who, distance = kmeans.Annuli(centroids[order]).nearest(x)
        assert distance[0] == 100 and who[0] == min(i for i, j in enumerate(order) if j < 2)
