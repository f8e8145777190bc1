import random
import re

import numpy as np
import pyarrow as pa

from quern.llm import minhash
from quern.llm.common import text_buffer
from quern.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, width, percent):
    """Sets of word tuples, all pairs that share a shingle, union-find."""
    sets = {}
    for i, (d, t) in enumerate(rows):
        w = WORD.findall((t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    at = {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    seen = set()
    for group in at.values():
        for x in range(len(group)):
            for y in range(x):
                seen.add((group[y], group[x]))
    for a, b in seen:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 12)):
            c = list(base)
            for _ in range(rng.randint(0, max(1, len(c) // 25))):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            texts.append((" " if rng.random() < 0.5 else "\n\t").join(c).upper() if rng.random() < 0.3 else " ".join(c))
    texts += ["", None, "   \n", "one", "ONE", "one two", "one two", "one  two", "x" * 30000 + " y z"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, component_id string, kept int")
    for width, percent in ((3, 85), (5, 80)):
        got = minhash.near_duplicates(docs, width, percent).collect()
        assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows, width, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z z"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows, 3, 85)
    assert minhash.near_duplicates(docs.where("false"), 3, 85).count() == 0


def test_chain_links_are_found_through_non_representatives(spark):
    """A long chain of small edits: neighbours are linked, the ends are not."""
    rng = random.Random(1)
    words = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rng.randrange(200)] = f"n{i}"
        words[rng.randrange(200)] = f"m{i}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows, 3, 85)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 3000, np.uint64))
    b = np.concatenate([a[:2400], np.unique(rng.integers(0, 1 << 63, 600, np.uint64))])
    same = np.mean(minhash.signature(a) == minhash.signature(b))
    assert abs(same - 2400 / 3600) < 0.15


def test_hidden_pairs_blocks(spark):
    """A bucket over several blocks loses no pair."""
    old = minhash.BLOCK
    minhash.BLOCK = 3
    try:
        rows = corpus(8)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = minhash.near_duplicates(docs, 3, 85).collect()
        assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows, 3, 85)
    finally:
        minhash.BLOCK = old


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_respect_document_borders():
    data, off = text_buffer(pa.array([b"a b", b"c d", b""], pa.binary()))
    assert [len(s) for s in minhash.shingle_sets(data, off, 3)] == [1, 1, 0]


def test_words_of_a_regular_make_are_told_apart(spark):
    """Words that a polynomial hash modulo a power of two takes for one another."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    sets = minhash.shingle_sets(*text_buffer(pa.array([f"{w} x y z".encode() for w in (a, b)], pa.binary())), 3)
    assert not np.intersect1d(sets[0][:1], sets[1]).size or len(np.intersect1d(*sets)) == 1
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {a}"), (4, f"{a} {b}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 3, 85).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_hash_of_spans_tells_bytes_and_sizes_apart():
    from quern.llm.common import span_hash

    rng = np.random.default_rng(0)
    parts = [b"", b"\0", b"\0\0", b"a", b"a\0", bytes(8), bytes(9), bytes(300), bytes(301), *(rng.integers(0, 3, n, dtype=np.uint8).tobytes() for n in range(1, 400))]
    data, end = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
    h = span_hash(data, end - [len(p) for p in parts], end)
    assert len(set(h.tolist())) == len(set(parts))
    again = span_hash(np.frombuffer(b"xy" + b"".join(parts), np.uint8), end - [len(p) for p in parts] + 2, end + 2)
    assert (h == again).all()


def test_links_lead_through_rows_without_a_doc_id(spark):
    """The middle of a chain has no doc_id; negative ids and one doc_id with two texts besides."""
    words = [f"t{i}" for i in range(100)]
    middle, end = [*words[:97], "m1", "m2", "m3"], ["e1", "e2", "e3", *words[3:97], "m1", "m2", "m3"]
    rows = [(9, " ".join(words)), (None, " ".join(middle)), (-4, " ".join(end)), (5, "quite another text"), (5, " ".join(reversed(words))), (6, " ".join([*reversed(words)][:99])), (None, "quite another text here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows, 3, 85)
    assert {r.component_id for r in got if r.doc_id in (9, -4)} == {-4}


def test_class_keys_sort_like_doc_ids(spark):
    from pyspark.sql import functions as F

    ids = [-(1 << 63), -5, -1, 0, 1, 255, 256, 1 << 40, (1 << 63) - 1, None]
    df = spark.createDataFrame([(i, b"x" * 16) for i in ids], "i long, c binary").select("i", minhash.class_key(F.col("i"), F.col("c")).alias("k"))
    rows = df.select("i", "k", minhash.first_of(F.col("k")).alias("back"), minhash.content_of(F.col("k")).alias("c")).orderBy("k").collect()
    assert [r.i for r in rows] == ids and all(r.back == r.i and bytes(r.c) == b"x" * 16 for r in rows)


def test_pairs_that_fail_are_never_rows(spark, monkeypatch):
    """Near copies whose similarity to each other lies just under the threshold: what comes out of the blocks are
    links that join components, fewer than there are classes."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        c = list(base)
        for at in rng.sample(range(10, 290, 6), 9):
            c[at] = f"x{rng.random()}"
        texts.append(" ".join(c))
    rows = list(enumerate(texts))
    made = []
    before = minhash.hidden_links
    monkeypatch.setattr(minhash, "hidden_links", lambda *a: made.append(before(*a)) or made[-1])
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 40_000)  # several blocks
    counts = []
    held = minhash.Scratch.__call__

    def call(self, df, name):
        out = held(self, df, name)
        if name == "minhash-hidden":
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash.Scratch, "__call__", call)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs, 3, 85).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute(rows, 3, 85)
    assert len(made) == 1 and counts[0] < len(rows)
