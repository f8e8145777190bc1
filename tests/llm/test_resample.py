import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import resample
from quern.llm.common import expanded, text_buffer

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    return len(w), [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute(docs, target, percent=25, seed=7, least=20, buckets=10_000):
    have, want = Counter(), Counter()
    for count, texts in ((have, [t for _, t in docs]), (want, target)):
        for t in texts:
            count.update(features(t, buckets)[1])
    s, t = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets))))
    rows = []
    for d, text in docs:
        n, own = features(text, buckets)
        weight = sum(map(gain, own)) // len(own) if own else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(own), weight, score, n])
    able = sorted((r for r in rows if r[4] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1], r[2]))
    out = [(*r[:4], None) for r in rows]
    left = Counter(out)
    for i, r in enumerate(able[: percent * len(able) // 100]):
        left[(*r[:4], None)] -= 1
        left[(*r[:4], i + 1)] += 1
    return sorted(left.elements(), key=str)


def corpus(n=300, seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Été", "ÀB", "naïve", "数据", "x" * 70, "y" * 5000, "\U0001f600"]
    text = lambda: " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))
    return [(i, text()) for i in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = corpus() + [(1000, None), (1001, ""), (1002, "..., -- ..."), (None, "a " * 30), (1003, "word"), (1004, "b-" * 20), (5, "c " * 25), (1005, "a\x00b\x7fc " * 10)]
    target = ["w1 w2 w3 w4", None, "", "w5 w1 w2 数据"]
    docs = spark.createDataFrame([(t, 1, d, 2) for d, t in rows], "text string, score int, doc_id long, copies int").repartition(3)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample.resample(docs, bench)) == brute(rows, target)
    assert got(resample.resample(docs, bench, percent=100, least_words=1, buckets=7)) == brute(rows, target, 100, 7, 1, 7)
    assert got(resample.resample(docs, bench.limit(0), percent=1, seed=3)) == brute(rows, [], 1, 3)
    assert got(resample.resample(docs.limit(0), bench)) == []


def test_repeated_rows_and_ties(spark):
    """A third of all rows are one, and many scores are alike (weights of one text, few noise levels)."""
    rows = corpus(60) + [(3, "d " * 40)] * 5000 + [(3, "d " * 41)] * 20 + [(100 + i, "e " * 30) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = resample.resample(docs, spark.createDataFrame([("d d d",)], "text string"), percent=90)
    assert got(out) == brute(rows, ["d d d"], 90)


def test_no_document_is_long_enough(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert got(resample.resample(docs, docs.select("text"))) == brute([(1, "a b"), (2, None)], ["a b", None])


@pytest.mark.parametrize("length", [0, 1, 47, 48, 49, 300])
def test_crc_of_spans(length):
    import pyarrow as pa

    texts = [("ab" * 200)[:length], "x", "", ("é" * 200)[:length]]
    data, off = text_buffer(pa.array(texts))
    out = resample.crc_on(np.full(len(texts), 0xFFFFFFFF, np.uint32), data, off[:-1], off[1:]) ^ np.uint32(0xFFFFFFFF)
    assert out.tolist() == [zlib.crc32(t.encode()) for t in texts]


def test_levels_are_bounded():
    most = resample.gains(np.array([0, 1 << 62]), np.array([1 << 62, 0]))
    noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in (0, (1 << 32) - 1)]
    assert int(most.max() - most.min()) + noise[1] - noise[0] < resample.LEVELS


def test_expanded(spark):
    df = spark.createDataFrame([("a", 1), ("b", 4096), ("c", 4097), ("d", 9000)], "k string, n long")
    out = expanded(df, "n", "i").groupBy("k").agg({"i": "max", "n": "count"}).collect()
    assert {(r["k"], r["max(i)"], r["count(n)"]) for r in out} == {("a", 0, 1), ("b", 4095, 4096), ("c", 4096, 4097), ("d", 8999, 9000)}
