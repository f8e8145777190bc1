import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quern.llm import learn, quality, toxicity


def sentences(seed, bias):
    """Insults make a text toxic; with `bias`, toxic texts mostly mention one group."""
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(400):
        y = i % 4 == 0
        t = [rng.choice(words) for _ in range(20)]
        if y:
            t.insert(5, rng.choice(["idiotic", "scummy", "worthless"]))
        if rng.random() < (bias if y else 0.02):
            t.insert(9, "muslim")
        rows.append((i, " ".join(t), int(y)))
    return rows


def test_counterfactual_penalty_frees_neutral_mentions():
    rows = sentences(1, 0.9)
    neutral = ["wba wcc muslim wdd", "muslim", "waa christian wbb"]
    plain, tied = toxicity.fit(rows, counterfactual=0.0), toxicity.fit(rows, counterfactual=5.0)
    assert plain.score(neutral[:1])[0] > 2 * tied.score(neutral[:1])[0] and tied.score(neutral).max() < 0.5
    a, b = tied.score(["waa muslim wbb", "waa christian wbb"])
    assert abs(a - b) < 0.05
    toxic = [t for _, t, y in rows if y]
    assert (tied.score(toxic) >= 0.5).mean() > 0.9


def test_swaps_cover_every_sentence():
    rng = random.Random(7)
    terms = {"a": ["muslim", "christian", "jewish"], "b": ["deaf", "blind"]}
    words = ["muslim", "jewish", "deaf", "musliming", "blindly", *(f"w{chr(97 + i)}" for i in range(20))]
    texts = ["", "\n \n", *("\n".join(". ".join(" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(6)) for _ in range(4)) for _ in range(30))]
    flat, pairs, drawn = [t for v in terms.values() for t in v], [], 0
    for s in [s for t in texts for line in t.split("\n") for s in line.split(". ") if s.strip()]:
        w = s.split()
        held = [(i, o) for i, x in enumerate(w) for v in terms.values() if x in v for o in v if o != x]
        pairs += [(s, " ".join([*w[:i], o, *w[i + 1 :]])) for i, o in held]
        if not held:
            group = [terms["a"], terms["b"]][drawn % 2]
            a, b = group[drawn // 2 % len(group)], group[(drawn // 2 + 1) % len(group)]
            pairs += [(f"{s} {a}", f"{s} {b}"), (s, f"{s} {a}")]
            drawn += 1
    tied, gram, n = toxicity.swap_gram(texts, terms, step=17)
    d = toxicity.matrix([p[0] for p in pairs], tied).astype(float) - toxicity.matrix([p[1] for p in pairs], tied)
    assert n == len(pairs) > 1000 and np.allclose(gram, d.T @ d, atol=1e-3)
    assert all(gram[np.searchsorted(tied, toxicity.features([t])[1][0])].any() for t in flat)


def test_late_mentions_are_swapped():
    rows = [(i, f"waa wbb. wcc. wdd. wee\n{t.replace('muslim', 'jewish')}", y) for i, t, y in sentences(1, 0.9)]
    plain, tied = toxicity.fit(rows, counterfactual=0.0), toxicity.fit(rows, counterfactual=5.0)
    effect = [m.weight[np.searchsorted(m.vocabulary, toxicity.features(["jewish"])[1])].sum() for m in (plain, tied)]
    assert effect[0] > 1 and abs(effect[1]) < 0.2 * effect[0]


def test_toxicity_defined_cases():
    none = toxicity.fit([])
    assert none.score(["", "x"]).max() < 1e-9 and toxicity.fit([(1, "a", 1)]).score(["z"])[0] > 0.99
    m = toxicity.fit(sentences(2, 0.1))
    assert np.allclose(m.score(["", "waa " * 3]), [m.score([""])[0], m.score(["waa " * 3])[0]])
    assert 0 <= m.score(["idiotic " * 100_000])[0] <= 1


def test_flat_trees_equal_a_walk_of_each():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    f = quality.fit(x, y, trees=20)
    for i in range(40):
        total = f.bias
        for r in f.roots:
            k = r
            while f.left[k] != k:
                k = f.left[k] if x[i, f.feature[k]] <= f.threshold[k] else f.right[k]
            total += f.value[k]
        assert abs(total - f.log_odds(x[i : i + 1])[0]) < 1e-9
    assert ((f.score(x) > 0.5) == y).mean() > 0.95


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "One two. Three!", "a\nb\na\n", "ÉÉ x 12", "#" * 50, " ", "LOUD!! WORDS!!", "x" * 40_000]
    together = quality.of_texts(texts)
    assert np.allclose(together, np.concatenate([quality.of_texts([t]) for t in texts])) and np.isfinite(together).all()


def test_held_out_rule(spark):
    ids = list(range(60))
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(learn.held_out(F.col("doc_id"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]


def test_tables(spark):
    rows = sentences(3, 0.1)
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t, _ in rows] + [(900, None, None, None), (901, "", "s", "l"), (5, rows[5][1], "s", "l")], "doc_id long, text string, score string, lang string")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    used = learn.training_rows(docs, labels, "toxic")
    assert all(zlib.crc32(str(d).encode()) % 5 for d, _, _ in used) and len(used) == len({d for d, _, _ in used})
    for judged in (toxicity.judged(docs, labels), quality.judged(docs, labels)):
        out = judged.collect()
        assert len(out) == 403 and all(0 <= r.score <= 1 for r in out) and sum(r.doc_id == 5 for r in out) == 2
    hits = {r.doc_id: r.predicted for r in toxicity.judged(docs, labels).where("held_out").collect()}
    assert np.mean([hits[i] == y for i, _, y in rows if i in hits]) > 0.9
    assert toxicity.judged(docs.where("false"), labels).count() == 0 and quality.judged(docs, labels.where("false")).first()["score"] == 0.5


ODD = ["", "One two. Three!", "a\nb\na\n", "ÉÉ x 12 é", "#" * 50, " ", "\n", "LOUD!! WORDS!! loud", "x" * 40_000 + " y", "a b a b a b\n\na b", "\t tab\x0b\x0cend\r\n", "AB Ab aB A1 {x} $5 a@b", "日本語 テキスト", "same\nsame\nsame", "x\0y \0"]


def plain_statistics(text):
    """The statistics of quality.NAMES, one document at a time."""
    b = text.encode()
    words, size = re.findall(rb"[^\x20\x09-\x0D]+", b), max(len(b), 1)
    of = lambda members: sum(c in members for c in b) / size
    n, lines = max(len(words), 1), b.count(b"\n") + 1
    symbols = b"#$%&*|<>{}[]=+~^_@/\\!"
    upper = [sum(65 <= c <= 90 for c in w) for w in words]
    pairs = list(zip(words, words[1:]))
    return [
        math.log1p(len(b)), math.log1p(len(words)), sum(map(len, words)) / n, of(range(65, 91)), of(range(48, 58)), of(b" \t\n\x0b\x0c\r"), of(range(128, 256)), of(symbols), of(b".,;:?-'\"()"), of(b"\n"),
        math.log1p(len(b) / lines), len(set(words)) / n**0.8, len(set(pairs)) / len(pairs) if pairs else 0, max(Counter(words).values(), default=0) / n, len(set(b.split(b"\n"))) / lines if b else 0,
        sum(any(c in symbols for c in w) for w in words) / n, sum(u >= 2 and u >= len(w) // 2 for u, w in zip(upper, words)) / n,
        math.log1p(sum(len(w) ** 2 for w in words) / n), math.log1p(len(words) / (sum(c in b".?!;" for c in b) + 1)),
    ]


def test_statistics_equal_a_plain_count():
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abA1 \n.#!é") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    assert len(quality.NAMES) == 19
    assert np.allclose(quality.of_texts(texts), [plain_statistics(t) for t in texts])


def plain_features(text):
    """How often a text has each word and word beginning, as (0, word) and (length, beginning)."""
    out = Counter()
    for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
        out[0, w] += 1
        for n in toxicity.BEGINNINGS:
            if len(w) > n:
                out[n, w[:n]] += 1
    return out


def hashed(feature):
    n, raw = feature
    return int(toxicity.span_hash(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0]) ^ n


def test_toxicity_equals_a_plain_count():
    """Which features are chosen, and the score, from dictionaries of counts."""
    rows = sentences(4, 0.3)
    model = toxicity.fit(rows)
    docs = [plain_features(t) for _, t, _ in rows]
    n1 = sum(y for _, _, y in rows)
    n0 = len(rows) - n1
    gain = {}
    for f in {f for d in docs for f in d}:
        pos, df = sum(f in d for d, r in zip(docs, rows) if r[2]), sum(f in d for d in docs)
        p1, p0 = (pos + 0.5) / (n1 + 1), (df - pos + 0.5) / (n0 + 1)
        gain[f] = abs(p1 - p0) / math.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) if df >= 4 else 0
    chosen = {f for f, g in gain.items() if g > 2.5} | {f for v in toxicity.IDENTITY_TERMS.values() for t in v for f in plain_features(t)}
    assert {int(h) for h in model.vocabulary} == {hashed(f) for f in chosen}
    weight = dict(zip(map(int, model.vocabulary), model.weight))
    for text in ["", *ODD, *(t for _, t, _ in rows[:40]), "muslim women idiotic scummy " * 9]:
        z = model.bias + sum(weight.get(hashed(f), 0) * math.log1p(n) for f, n in plain_features(text).items())
        assert abs(model.score([text])[0] - 1 / (1 + math.exp(-z))) < 1e-9


def test_crowded_cells_lose_no_feature(monkeypatch):
    """Features that share a cell with many others are still judged by their own counts."""
    monkeypatch.setattr(toxicity, "CELLS", 1 << 20)
    rows = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)]
    with np.errstate(invalid="raise"):
        model = toxicity.fit(rows)
    assert hashed((0, b"vile")) in {int(h) for h in model.vocabulary}


def test_columns_named_like_results(spark):
    rows = sentences(3, 0.1)
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t, _ in rows], "doc_id long, text string, score int, `_k0` string")
    labels = spark.createDataFrame([(i, 1 - y, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels), name="own").collect()
    assert all(r.score == 7 and r._k0 == "k" and 0 <= r.own <= 1 for r in out)
    out = quality.score(docs, quality.train(docs, labels), name="own").collect()
    assert all(r.score == 7 and 0 <= r.own <= 1 for r in out)


def test_learning_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    free = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5]
    every = learn.training_rows(docs, labels, "toxic")
    assert [r[0] for r in every] == free and every[0][1:] == ("x" * 100, free[0] % 2)
    some = learn.training_rows(docs, labels, "toxic", most=50)
    assert len(some) == 50 and some == learn.training_rows(docs.repartition(5), labels.repartition(3), "toxic", most=50)
    assert len(learn.training_rows(docs, labels, "toxic", most_bytes=1000)) == 10
    assert learn.training_rows(docs.where("false"), labels, "toxic") == []


def test_quality_of_no_documents_and_of_long_texts(spark):
    """An empty table, no labels, a text of 200,000 characters, columns that clash: whole texts are scored."""
    rows = [(1, "good words of a long text. " * 8000, 0.5), (2, None, 0.5), (3, "", 0.5), (None, "!!! " * 30, 0.5)] + [(10 + i, f"some words number {i} " * (i % 7 + 1), 0.5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(60)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    want = {d: s for (d, _, _), s in zip(rows, model.score(quality.of_texts([t or "" for _, t, _ in rows])))}
    got = {r.doc_id: r.score for r in quality.judged(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-12 for d in want)
    assert quality.judged(docs.limit(0), labels).collect() == [] and quality.judged(docs, labels.limit(0)).count() == len(rows)
    assert quality.judged(docs.limit(0), labels.limit(0)).columns == ["doc_id", "held_out", "score", "predicted"]
