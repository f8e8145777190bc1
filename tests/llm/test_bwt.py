import hashlib
import random

import numpy as np
import pytest

from quern.llm import bwt


def brute(rows, size=50):
    raw = [(t or "").encode() for _, t in rows]
    key = [bwt.LAST if d is None else d for d, _ in rows]
    least = {}
    for d, b in zip(key, raw):
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            least[w] = min(least.get(w, d), d)
    out = []
    for (doc_id, _), d, b in zip(rows, key, raw):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if least[b[i : i + size]] < d:
                gone[i : i + size] = True
        n = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), int(gone.sum()), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "é", "ß", "ing ", " ", "re", "\n", "0", "日本"]
    make = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    passages = [make(rng.randint(20, 120)) for _ in range(8)]
    texts = []
    for _ in range(60):
        t = make(rng.randint(0, 150))
        for p in rng.sample(passages, rng.randint(0, 3)):
            a = rng.randint(0, len(p) // 2)
            t += p[a : rng.randint(a, len(p))] + make(rng.randint(0, 30))
        texts.append(t)
    texts += texts[:10] + [t[:40] + "x" + t[40:] for t in texts[10:25]]
    texts += ["", None, "a" * 49, "a" * 50, "a" * 51, "a" * 500, "ab" * 300, "ab" * 40, "Und " * 200, "Und " * 90, "x" * 30 + "a" * 60]
    rng.shuffle(texts)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[3]), (None, texts[4]), rows[0], (rows[1][0], texts[7])]


@pytest.mark.parametrize("hot", [50_000, 3])
def test_equals_brute_force(spark, hot):
    rows = corpus(5 + hot % 7)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n_removed int")
    got = [(r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in bwt.cut_repeats(docs, hot=hot).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bwt.digests(docs).count() == 0


@pytest.mark.parametrize("part", [64, 400, 4 << 20])
def test_parts_do_not_change_the_spans(part, monkeypatch):
    """A bucket worked off in small parts gives the spans of a scan."""
    monkeypatch.setattr(bwt, "PART", part)
    rng = random.Random(part)
    snippets, places = [], []
    for key in range(12):
        base = bytes(rng.choice(b"xy") for _ in range(90))
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, 20)
            snippets.append((key, base[a : a + rng.randint(50, 70)]))
    for d in range(80):
        places.append((rng.randrange(len(snippets)), rng.randint(0, 30), d * 200))
    text = np.frombuffer(b"".join(t for _, t in snippets), np.uint8)
    cols = [np.array(c) for c in zip(*places)]
    place, first, end = bwt.covered(np.array([k for k, _ in snippets], np.uint64), np.array([len(t) for _, t in snippets]), text, cols[0], cols[1], cols[2])
    got = {(p, b) for p, f, e in zip(place.tolist(), first.tolist(), end.tolist()) for b in range(f, e)}
    least = {}
    for s, d, _ in places:
        k, t = snippets[s]
        for i in range(len(t) - 49):
            least[k, t[i : i + 50]] = min(d, least.get((k, t[i : i + 50]), d))
    want = {(p, at + i + j) for p, (s, d, at) in enumerate(places) for i in range(len(snippets[s][1]) - 49) if least[snippets[s][0], snippets[s][1][i : i + 50]] < d for j in range(50)}
    assert got == want


def test_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "q" * 80, "en"), (2, "z" + "q" * 80, None)], "doc_id long, text string, lang string")
    got = {r.k0: r for r in bwt.cut_repeats(docs, keep=["doc_id", "lang"]).collect()}
    assert bytes(got[2].kept) == b"z" and got[1].k1 == "en" and got[2].k1 is None


@pytest.mark.parametrize("size,shard", [(4, 8), (6, 20), (50, 100)])
def test_merged_transforms_give_the_repeated_windows(size, shard):
    rng = random.Random(size)
    base = bytes(rng.choice(b"abc") for _ in range(200))
    for _ in range(25):
        snippets = [base[(i := rng.randint(0, 150)) : i + rng.randint(1, 2 * size)] for _ in range(rng.randint(1, 12))]
        text = np.frombuffer(b"".join(s + b"\xff" for s in snippets), np.uint8)
        starts = np.cumsum([0] + [len(s) + 1 for s in snippets[:-1]])
        position, block = bwt.repeats(text, starts, size, shard)
        want = {int(b) + i: s[i : i + size] for s, b in zip(snippets, starts) for i in range(len(s) - size + 1)}
        assert sorted(position.tolist()) == sorted(want)
        groups = {}
        for p, b in zip(position.tolist(), block.tolist()):
            groups.setdefault(b, set()).add(want[p])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_common_prefixes_come_with_the_merge():
    a, b = b"banana$", b"bandana%"
    order, before = zip(*[bwt.shard_transform(np.frombuffer(t, np.uint8), 8) for t in (a, b)])
    place, common = bwt.interleave(list(before), 8)
    rotations = sorted([a[i:] + a[:i] for i in range(7)] + [b[i:] + b[:i] for i in range(8)], key=lambda r: (r * 2)[:8])
    merged = [None] * 15
    for g, p in enumerate(place.tolist()):
        t, o = (a, order[0][g]) if g < 7 else (b, order[1][g - 7])
        merged[p] = (t[o:] + t[:o]) * 2
    assert [m[:8] for m in merged] == [(r * 2)[:8] for r in rotations] and common[0] == 0
    for x, y, c in zip(merged, merged[1:], common[1:]):
        assert c == next((i for i in range(8) if x[i] != y[i]), 8) // 2 * 2


def test_snippets_are_equal_only_byte_by_byte(monkeypatch):
    monkeypatch.setattr(bwt, "span_hash", lambda data, start, end: np.zeros(len(start), np.uint64))
    text = np.frombuffer(b"abcabdabcabe", np.uint8)
    order, new = bwt.alike(np.zeros(4, np.uint64), np.array([0, 3, 6, 9]), np.full(4, 3), text)
    assert order.tolist() == [0, 1, 2, 3] and new.tolist() == [True] * 4
    order, new = bwt.alike(np.zeros(4, np.uint64), np.array([0, 6, 3, 9]), np.full(4, 3), text)
    assert new.tolist() == [True, False, True, True]


@pytest.mark.parametrize("gram", [5, 8, 13, 24])
def test_runs_of_windows(gram):
    """Every window of every text is in one run, all windows of a run share their least string."""
    rng = random.Random(gram)
    texts = [bytes(rng.choice(b"ab ") for _ in range(n)) for n in (0, 49, 50, 51, 200, 0, 7, 120)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    key, doc, lo, hi = bwt.window_runs(data, off, 50, gram)
    windows = [w for a, b in zip(lo.tolist(), hi.tolist()) for w in range(a, b + 1)]
    assert windows == [i for a, b in zip(off[:-1], off[1:]) for i in range(a, b - 49)]
    assert all(off[d] <= a and b + 50 <= off[d + 1] for d, a, b in zip(doc, lo, hi))
    hashes = bwt.gram_hash(data, gram)
    assert len(set(hashes.tolist())) == len({data[i : i + gram].tobytes() for i in range(len(data) - gram + 1)})
    assert all(bwt.mix(hashes[w : w + 51 - gram].min()[None])[0] == k for k, a, b in zip(key, lo, hi) for w in range(a, b + 1))


def test_hot_rows(spark):
    """One text in very many rows, under one doc_id, under many and under none."""
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(70))
    rows = [(7, line)] * 200 + [(None, line + "!")] * 100 + [(1000 + i, f"{i} {line} {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (50_000, 20):
        got = [(r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in bwt.cut_repeats(docs, hot=hot, block_bytes=2000).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_very_long_texts(spark):
    """Texts longer than what is worked off at once, alike in long stretches and in short ones."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(110_000))
    rows = [(3, long), (8, "x" + long[200_000:500_000] + "y" + long[10:90]), (1, long[650_000:650_070]), (2, "q" * 600_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r[0], r[1], r[2], r[3], hashlib.sha256(r[4]).hexdigest()) for r in bwt.cut_repeats(docs, block_bytes=200_000).collect()]
    assert sorted(got, key=str) == brute(rows)
