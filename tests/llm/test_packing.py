import random

import numpy as np

from quern.llm import packing
from quern.llm.queries import tokenizer_path
from quern.llm.tokenfile import Encoder


def plain(lengths, capacities, cost):
    """The same rule with linear scans."""
    bins, where, caps = [], [], []
    for i, x in enumerate(lengths):
        fit = [(c - sum(b), n) for n, (b, c) in enumerate(zip(bins, caps)) if c - sum(b) >= x]
        if fit:
            room = min(f[0] for f in fit)
            where.append((x, room))
            n = [f[1] for f in fit if f[0] == room]
            bins[max(n, key=lambda k: touched[k])].append(x)
            touched[max(n, key=lambda k: touched[k])] = i
            continue
        spoken = sum(c - sum(b) for b, c in zip(bins, caps))
        best = None
        for c in sorted(capacities):
            if c >= x:
                come = sum(y for y in lengths[i + 1 :] if y <= c - x)
                hold = x + min(c - x, max(0, come - spoken))
                if best is None or cost(c) / hold < best[0]:
                    best = (cost(c) / hold, c)
        bins.append([x]), caps.append(best[1])
        if len(bins) == 1:
            touched = {}
        touched[len(bins) - 1] = i
    return sorted((min(c for c in capacities if c >= sum(b)), tuple(b)) for b in bins)


def test_equals_the_plain_rule():
    for seed in range(40):
        rng = random.Random(seed)
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, offsets, sizes = packing.best_fit(lengths, (16, 32, 64))
        groups = {}
        for b, o, x in zip(bins, offsets, lengths):
            groups.setdefault(b, []).append((o, x))
        for b, g in groups.items():
            at = 0
            for o, x in sorted(g):
                assert o == at
                at += x
            assert at <= sizes[b] and all(c < at for c in (16, 32, 64) if c < sizes[b])
        got = sorted((sizes[b], tuple(x for _, x in sorted(g))) for b, g in groups.items())
        assert got == plain(lengths, (16, 32, 64), packing.sequence_cost)


def test_little_is_wasted_and_sizes_vary():
    rng = random.Random(1)
    lengths = sorted((min(8192, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(5000)), reverse=True)
    _, _, sizes = packing.best_fit(lengths)
    assert sum(lengths) / sum(sizes) > 0.97 and len(set(sizes)) > 1


def test_table(spark):
    rows = [(i, n) for i, n in enumerate([5, 0, None, -3, 9000, 8192, 20000, 1, 1, 1024])] + [(5, 8192), (None, 7)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), group_rows=4).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id,), []).append(r)
    assert sum(r.n_tokens for r in got) == sum(max(0, n or 0) for _, n in rows)
    assert all(r.bin is None and r.capacity is None for d in (1, 2, 3) for r in by[(d,)])
    assert sorted((r.piece, r.start, r.n_tokens) for r in by[(6,)]) == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 3616)]
    assert len(by[(5,)]) == 2 and len({r.bin for r in by[(5,)]}) == 2
    bins = {}
    for r in got:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append((r.offset, r.n_tokens, r.capacity))
    for b in bins.values():
        at = 0
        for o, n, c in sorted(b):
            assert o == at and o + n <= c
            at += n
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_sequences_hold_every_token_once(spark):
    rng = random.Random(3)
    words = ["alpha", "beta,", "gamma\n", "Straße", "10", "δέλτα"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200, 700])))) for i in range(60)]
    rows += [(1007, "again and again")] * 30 + [(None, "no id")] * 30 + [(61, None), (62, "")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, bin string")
    path = tokenizer_path("byte_bpe_50k.json")
    enc = Encoder(path)
    out = packing.sequences(docs, path, capacities=(64, 128, 256), group_rows=25).collect()
    want = sorted(((-1 if d is None else d), tuple(np.frombuffer(enc.encode(t or ""), "<u4").tolist() + [0])) for d, t in rows)
    parts = {}
    for r in out:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert r.n_tokens == len(ids) == sum(r.lengths) <= r.capacity and all(c < len(ids) for c in (64, 128, 256) if c < r.capacity)
        at = 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths):
            parts.setdefault(-1 if d is None else d, []).append((s, tuple(ids[at : at + n])))
            at += n
    assert len({r.bin for r in out}) == len(out)
    for d in {d for d, _ in want}:
        own = [t for e, t in want if e == d]
        if len(own) == 1:
            assert sum((p for _, p in sorted(parts[d])), ()) == own[0]
        else:
            assert sorted(p for _, p in parts[d]) == own
    groups = [r.bin >> 32 for r in out if 1007 in r.doc_ids]
    assert len(set(groups)) > 1  # a repeated row is spread over groups
    assert packing.sequences(docs.where("false"), path).count() == 0
    assert packing.digests(packing.sequences(docs, path)).columns == ["bin", "capacity", "n_tokens", "doc_ids", "starts", "lengths", "ids_crc32"]
