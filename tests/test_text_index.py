"""Postings and BM25 against plain loops, suggestions against brute-force edit distance."""

from collections import Counter
from math import log

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.sources import text_index
from quern.sources.text_index import TextIndex, TitleIndex, words


def plain(rows, query, k):
    texts = [(i, Counter(words(t))) for i, t in rows]
    mean = sum(sum(c.values()) for _, c in texts) / len(texts) or 1.0
    out = []
    for i, c in texts:
        score, size = 0.0, sum(c.values())
        for w in set(words(query)) & set(c):
            have = sum(w in x for _, x in texts)
            score += log(1 + (len(texts) - have + 0.5) / (have + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
        if set(words(query)) & set(c):
            out.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    vocabulary = ["the"] * 200 + ["of"] * 100 + [f"w{i}" for i in range(300)] * 1 + ["été", "数据", "x2"]
    rows = [(f"t{i:03d}", " ".join(rng.choice(vocabulary, int(rng.integers(1, 80))))) for i in range(400)]
    return [*rows, ("empty", ""), ("null", None), ("marks", "... -- !"), ("odd", "The_the THE's w1-w2 été")]


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    docs = spark.createDataFrame([(t, 1, i, "x") for i, t in corpus] + [("the", 2, None, "y")], "content string, n int, title string, term string").repartition(3)
    return TextIndex(spark, str(tmp_path_factory.mktemp("index"))).build(docs)


QUERIES = ["the of", "The w5 W7", "w1", "été of the w9", "数据 x2 the", "none such", "", "the the the", "w1 w2 w3 w4 w5 of"]


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_equal_plain_loops(index, corpus, query):
    got = [(r.id, round(r.score, 9)) for r in index.search(query, 7).collect()]
    want = plain(corpus, query, 7)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


def test_many_queries_at_once(spark, index, corpus):
    asked = spark.createDataFrame(list(enumerate([*QUERIES, None])), "query_id int, text string")
    got = sorted((r.query_id, r.id, round(r.score, 6)) for r in index.search_all(asked, 3).collect())
    assert got == sorted((q, i, round(s, 6)) for q, text in enumerate(QUERIES) for i, s in plain(corpus, text, 3))


def test_bounds_leave_frequent_words_to_the_candidates(spark, index, corpus, monkeypatch):
    """With a rare word of great weight, the postings of `the` are joined with the candidates; the ranks stay."""
    joined = []
    plan = index.search("w9 w10 w11 w12 the", 2)
    joined.append("LeftSemi" in plan._jdf.queryExecution().toString())
    monkeypatch.setattr(text_index, "FREQUENT", 2.0)
    same = index.search("w9 w10 w11 w12 the", 2)
    assert joined == [True] and "LeftSemi" not in same._jdf.queryExecution().toString()
    assert [r.id for r in plan.collect()] == [r.id for r in same.collect()] == [i for i, _ in plain(corpus, "w9 w10 w11 w12 the", 2)]


def test_a_search_reads_its_words_only(spark, index, tmp_path):
    """The folders of other words may be anything: they are not opened; terms are pushed to the files."""
    import shutil

    copy = TextIndex(spark, str(tmp_path / "copy"))
    shutil.copytree(index.path, copy.path)
    want = copy.search("w5 w7", 5).collect()
    plan = copy.search("w5 w7", 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [w5,w7])]" in plan and "PartitionFilters: [folder" in plan
    own = {str(r.f) for r in spark.createDataFrame([("w5",), ("w7",)], "term string").select(text_index._folder(F.col("term")).alias("f")).collect()}
    for f in (tmp_path / "copy").glob("*/folder=*/*.parquet"):
        if f.parent.name.split("=")[1] not in own:
            f.write_bytes(b"not to be read")
    assert copy.search("w5 w7", 5).collect() == want


def test_no_texts(spark, tmp_path):
    empty = TextIndex(spark, str(tmp_path / "e")).build(spark.createDataFrame([], "title string, content string"))
    assert empty.search("the", 3).collect() == []
    blank = TextIndex(spark, str(tmp_path / "b")).build(spark.createDataFrame([("a", None), ("b", "--")], "title string, content string"))
    assert blank.search("the", 3).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(titles, queries, most):
    out = []
    for q, text in queries:
        found = sorted((e, t) for t in set(titles) if t is not None and text is not None and (e := edits(text.lower(), t.lower())) <= 2)
        out += [(q, n + 1, t, e) for n, (e, t) in enumerate(found[:most])]
    return sorted(out)


def test_suggestions_equal_brute_force(spark, tmp_path):
    rng = np.random.default_rng(4)
    letters = list("abcé ")
    titles = ["".join(rng.choice(letters, int(rng.integers(0, 9)))) for _ in range(250)] + ["Berlin", "Bern", "Berlin", "BERLIN WALL", "Brno", None, "数据库", "Straße", "x" * 300]
    asked = ["berlin", "Brelin", "bern", "berl wall", "", "a", None, "数据", "strase", "x" * 298, "x" * 297] + ["".join(rng.choice(letters, int(rng.integers(0, 9)))) for _ in range(80)]
    queries = list(enumerate(asked))
    index = TitleIndex(spark, str(tmp_path / "t")).build(spark.createDataFrame([(t, "d") for t in titles], "title string, no string"))
    frame = spark.createDataFrame(queries, "query_id int, text string")
    got = sorted(tuple(r) for r in index.near(frame, 4).collect())
    assert got == nearest(titles, queries, 4)
    assert "CartesianProduct" not in index.near(frame, 4)._jdf.queryExecution().toString()


def test_suggestions_with_numbers_equal_brute_force(spark, tmp_path):
    """Edits in digits, in the rest and across both, short texts that are near many, and more digits than DIGITS."""
    rng = np.random.default_rng(9)

    def some(n, alphabet, low, high):
        return ["".join(rng.choice(list(alphabet), int(rng.integers(low, high)))) for _ in range(n)]

    titles = some(120, "ab12", 0, 7) + some(60, "a/0123", 4, 10) + some(30, "01", 10, 16) + some(30, "x01", 11, 17)
    asked = some(80, "ab12", 0, 7)
    for t in titles[-80:]:
        text = list(t)
        for new, at in zip(some(2, "x01", 1, 2), rng.integers(0, len(t) - 1, 2).tolist()):
            text[at : at + int(rng.integers(0, 2))] = [new] if rng.integers(0, 2) else []
        asked.append("".join(text))
    queries = list(enumerate(asked))
    index = TitleIndex(spark, str(tmp_path / "t")).build(spark.createDataFrame([(t,) for t in titles], "title string"))
    got = sorted(tuple(r) for r in index.near(spark.createDataFrame(queries, "query_id int, text string"), 300).collect())
    assert got == nearest(titles, queries, 300)


def test_titles_that_differ_in_numbers_are_not_all_compared(spark, tmp_path, monkeypatch):
    """With a comparison that lets all pass, near() gives whatever meets: 400 addresses of one site are not 160,000 pairs."""
    titles = [f"https://site.example.org/en/{100_000 + 7919 * i % 900_000}?page=2&ref=x" for i in range(400)]
    index = TitleIndex(spark, str(tmp_path / "t")).build(spark.createDataFrame([(t,) for t in titles], "title string"))
    monkeypatch.setattr(F, "levenshtein", lambda *_: F.lit(0))
    met = index.near(spark.createDataFrame(list(enumerate(titles)), "query_id int, text string"), 10**6).count()
    assert 400 <= met <= 10 * 400


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["", "a", "b", "ab"])), max_size=2))
def test_titles_within_two_edits_share_a_piece(title, changes):
    """The rule alone, with the pieces as the index cuts them."""
    text = title
    for at, new in changes:
        at = min(at, len(text))
        text = text[:at] + new[:1] + text[at + (1 if len(new) != 1 else 0) :]
    if edits(title, text) <= 2:
        cut = [i * len(title) // 3 for i in range(4)]
        assert any(0 <= a + s and text[a + s : a + s + z - a] == title[a:z] and a + s + z - a <= len(text) for a, z in zip(cut, cut[1:]) for s in range(-2, 3))


def test_search_with_a_suggestion(spark, index, tmp_path):
    titles = TitleIndex(spark, str(tmp_path / "t")).build(spark.createDataFrame([("Berlin",), ("Paris",)], "title string"))
    hits, other = text_index.search_with_suggestion(index, titles, "Berlni", 2)
    assert hits.collect() == [] and other == "Berlin"
    assert text_index.search_with_suggestion(index, titles, "Paris", 2)[1] is None
