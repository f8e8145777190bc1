import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import cuckoo


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows."""
    groups = {}
    for d, t in rows:
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest(), []).append((d, len(t or "")))
    out = []
    for sha, own in groups.items():
        own.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out += [(d, own[0][0], len(own), i == 0, sha) for i, (d, _) in enumerate(own)]
    return sorted(out, key=str)


def verdicts(index):
    return sorted((tuple(r) for r in index.verdicts().collect()), key=str)


CASES = [
    (1, "a b"), (2, "ab "), (3, " a\tb\n"), (4, "a b"), (5, None), (6, ""), (7, " \r\n\x0b\x0c"), (None, "ab"), (None, "a b  \x0c"), (8, "x" * 300_000), (9, "x" * 150_000 + " " + "x" * 150_000),
    (10, "été \U0001f600"), (11, "été\U0001f600 "), (10, "été \U0001f600"), (1, "a b"), (12, "A b"), (2**60, "ab  "), (13, "\x00"), (14, "\x1c \x1f"),
]


def test_verdicts_equal_brute_force(spark):
    df = spark.createDataFrame([(t, d, 3, "x", "y") for d, t in CASES], "text string, doc_id long, digest int, keep_id string, copies string")
    got = sorted((tuple(r) for r in cuckoo.deduplicated(df).collect()), key=str)
    assert got == brute(CASES)


def test_many_copies_and_an_empty_table(spark):
    rows = [(i % 500, "hot  text") for i in range(3000)] + [(10_000 + i, f"own {i}") for i in range(2000)] + [(7, "hot text of one id")] * 900
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in cuckoo.deduplicated(df).collect()), key=str) == brute(rows)
    assert cuckoo.deduplicated(df.limit(0)).collect() == []


def test_copies_are_brought_together_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "one text") for i in range(5000)], "doc_id long, text string").coalesce(1)
    assert cuckoo.partial_groups(cuckoo.digested(df)).count() == 1


def test_rows_come_and_go(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = cuckoo.DigestIndex(spark, shards=3)
    index.delete(frame([(1, "a")]))
    first = [(i, f"text {i % 40}") for i in range(100)] + [(5, "text 5")]
    index.insert(frame(first))
    assert verdicts(index) == brute(first)
    second = [(i, f"text {i % 40} ") for i in range(200, 220)] + [(300, "new")]
    index.insert(frame(second))
    live = first + second
    assert verdicts(index) == brute(live)
    gone = [(200, "text 0 "), (5, "text 5"), (300, "new"), (300, "new"), (77, "never"), (0, "text 0")] + [(i, "text 39") for i in (39, 79)]
    index.delete(frame(gone))
    for r in gone:
        if r in live:
            live.remove(r)
    assert verdicts(index) == brute(live)
    asked = [(1, "text39"), (2, "new"), (3, " text 1"), (4, "text 0"), (5, None)]
    keep = {sha: k for _, k, _, _, sha in brute(live)}
    want = sorted((d, keep[s]) for d, _, _, _, s in brute(asked) if s in keep)
    assert sorted(map(tuple, index.find(frame(asked)).collect())) == want and want


def keys(rng, n):
    return rng.integers(0, 1 << 63, (n, 4), np.uint64)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_overflow_resizes_from_the_stored_keys(n):
    rng = np.random.default_rng(n)
    index, key = cuckoo.Cuckoo(2), keys(rng, n)
    for part in np.array_split(key, 7):
        number = index.insert(part)
        assert (index.find(part) == number).all() and index.hinted(part).all()
    assert (index.keys[index.find(key)] == key).all() and len(index) == n and (n < 10 or index.resizes > 3)
    assert (index.find(keys(rng, 500)) == -1).all() and index.hinted(keys(rng, 2000)).mean() < 0.01
    gone = key[::2]
    index.delete(index.find(gone))
    assert (index.find(gone) == -1).all() and (index.find(key[1::2]) >= 0).all()
    more = keys(rng, n // 2)
    index.insert(more)
    assert (index.find(more) >= 0).all() and (index.find(key[1::2]) >= 0).all() and len(index.keys) <= n + 1


def test_a_hit_that_is_no_hit():
    """Keys of one fingerprint and bucket differ in what the filter doesn't see."""
    index = cuckoo.Cuckoo(64)
    alike = np.tile(keys(np.random.default_rng(3), 1), (40, 1))
    alike[:, 3] = np.arange(40)
    index.insert(alike[:6])
    assert (index.find(alike[:6]) >= 0).all() and index.hinted(alike).all() and (index.find(alike[6:]) == -1).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=200))
def test_like_a_set(steps):
    pool = keys(np.random.default_rng(9), 61)
    index, live = cuckoo.Cuckoo(2), set()
    for come, i in steps:
        own = index.find(pool[i : i + 1])
        assert (own[0] >= 0) == (i in live)
        if come and i not in live:
            index.insert(pool[i : i + 1])
            live.add(i)
        elif not come and i in live:
            index.delete(own)
            live.discard(i)
    again = cuckoo.Cuckoo.of(index.filter_bytes(), index.keys[index.place >= 0], index.place[index.place >= 0])
    assert {i for i in range(61) if again.find(pool[i : i + 1])[0] >= 0} == live
