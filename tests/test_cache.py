"""Caches that know their inputs, and answers by rounds against a plain loop."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quern.config import Config, StoreConfig
from quern.operators import retrieval
from quern.plans import ingest, iterate
from quern.plans.answer import PROMPT
from quern.providers import DASHES, Answer, ChatModel, HashedEmbedding, Providers, Request, RuleText
from quern.sources import cache
from test_engine import pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def counted(path):
    class Counted(RuleText):
        def complete(self, request):
            with open(path, "a") as f:
                f.write(f"{request.stage}|{request.title}|{(request.text or '')[:12]}\n")
            return super().complete(request)

    return Counted()


def test_one_page_changed_one_page_derived(spark, tmp_path):
    log = tmp_path / "calls"
    corpus, p = pages(spark, 3), Providers(HashedEmbedding(8), counted(str(log)))
    config = Config(store=StoreConfig(path=str(tmp_path / "g")))
    calls = lambda: log.read_text().count("summary|") if log.exists() else 0
    graph = ingest.ingest(spark, corpus, "Berlin", 3, p, config)
    first, sections = calls(), graph.nodes().where("type in ('section', 'subsection')").count()
    assert first == sections > 0
    changed = corpus.withColumn("content", F.when(F.col("page_id") == "1", F.concat("content", F.lit("\n== New ==\nBerlin changed."))).otherwise(F.col("content")))
    newer = ingest.ingest(spark, changed, "Berlin", 3, p, config)
    assert calls() == first + sections // 3 + 1  # the pages as they were cost nothing
    titles = {(r.page_id, r.title) for r in newer.nodes().where("type = 'section'").collect()}
    assert ("1", "New") in titles and ("0", "New") not in titles and newer.nodes().select("page_id").distinct().count() == 3
    other = Providers(HashedEmbedding(8), RuleText(summary_sentences=1))
    assert cache.models_print(other) != cache.models_print(p)


def test_fingerprints(spark):
    rows = [("a", "x", None), ("b", "x", ""), ("c", "x", "1"), ("d", "x1", "")]
    df = spark.createDataFrame(rows, "k string, page_id string, content string")
    prints = [r[0] for r in df.select(cache.page_print(df.drop("k"), "m")).collect()]
    assert len(set(prints)) == 4 and df.select(cache.page_print(df.drop("k"), "n")).first()[0] not in prints
    assert cache.models_print(Providers(text=ChatModel("u", "secret"))) == cache.models_print(Providers(text=ChatModel("u", "other")))
    assert cache.models_print(Providers(text=ChatModel("u"))) != cache.models_print(Providers(text=ChatModel("u", temperature=0.1)))


def test_cache_of_odd_pages(spark, tmp_path):
    """No pages, pages without nodes, rows that repeat, a derivation that breaks off, batches nobody needs."""
    kept = cache.PageCache(spark, str(tmp_path / "c"))
    made = []

    def derive(new):
        made.append(sorted(r.page_id for r in new.collect()))
        return new.where("content != ''").select("page_id", F.upper("content").alias("text"))

    frame = lambda rows: spark.createDataFrame(rows, "page_id string, content string")
    assert kept.nodes(frame([]), derive, "m").collect() == []
    one = [("a", "x"), ("b", ""), ("b", ""), ("c", "y")]
    for _ in range(2):
        assert sorted(map(tuple, kept.nodes(frame(one), derive, "m").collect())) == [("a", "X"), ("c", "Y")]
    assert made[1:] == [["a", "b", "b", "c"]]
    with pytest.raises(ZeroDivisionError):
        kept.nodes(frame([("d", "z")]), lambda new: 1 / 0, "m")
    assert sorted(map(tuple, kept.nodes(frame([("a", "x"), ("d", "z")]), derive, "m").collect())) == [("a", "X"), ("d", "Z")]
    assert kept.forget(frame([("d", "z")]), "m") == 1 and made[-1] == ["d"]
    assert sorted(map(tuple, kept.nodes(frame([("d", "z")]), derive, "m").collect())) == [("d", "Z")] and made[-1] == ["d"]


class Chain:
    """Drafts that go one step beyond the facts: a link of the last entity the facts name, till `end`."""

    def answer(self, request):
        text = request.text or ""
        if request.stage == "check":
            draft, _, facts = text.partition(DASHES)
            return Answer("\n".join(s for s in draft.split(". ") if s and s.rstrip(".") not in facts))
        question, facts = text.split("\n")[0], text.split("\n")[3]
        at = question.split()[-1]
        said = []
        while (link := f"{at} leads to ") in facts:
            said.append(link + (at := facts.split(link)[1].split(" ")[0].strip(".")))
        return Answer(". ".join(said if at == "end" else [*said, f"{at} leads to what"]) + ".")


def plain_loop(question, facts, model, embed, rounds, k):
    """The same by hand, over lists."""
    if question is None:
        return None, 0, None
    known, queries = [], [question]
    for n in range(1, rounds + 1):
        found = {}
        for place, q in enumerate(queries):
            v = embed.embed([q])[0].astype(float)
            scored = []
            for i, t in facts:
                w = embed.embed([t])[0].astype(float)
                size = (v @ v) ** 0.5 * (w @ w) ** 0.5
                scored.append((-round(v @ w / size if size else 0.0, 9), i, t))
            for s, i, t in sorted(scored)[:k]:
                found[t] = min(found.get(t, (9, 9, "")), (place, s, i))
        known += [t for t in sorted(found, key=found.get) if t not in known]
        text = " ".join(known)
        draft = model.answer(Request("answer", PROMPT.format(question=question, texts=text or "none", images="none"))).text
        queries = [x.strip() for x in (model.answer(Request("check", draft + DASHES + text)).text or "").split("\n") if x.strip()]
        if not queries or n == rounds:
            return draft, n, queries or None


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds_equal_a_plain_loop(spark, rounds):
    facts = [(f"f{i}", f"{a} leads to {b}.") for i, (a, b) in enumerate([("one", "two"), ("two", "three"), ("three", "end"), ("red", "blue"), ("blue", "green"), ("green", "black"), ("black", "white"), ("lone", "end")])]
    asked = [(1, "where does one"), (2, "and red"), (3, "lone"), (4, "nothing known"), (5, None), (6, "where does one")]
    embed, model = HashedEmbedding(64), Chain()
    nodes = spark.createDataFrame([(i, t, "text", [float(x) for x in embed.embed([t])[0]]) for i, t in facts], "node_id string, text string, modality string, embedding array<float>")
    search = lambda q, k: retrieval.nearest(nodes, q, {None: k})
    got = iterate.answer_all(spark, spark.createDataFrame(asked, "question_id int, text string"), search, nodes, Providers(embed, model), rounds, 2)
    want = {i: plain_loop(q, facts, model, embed, rounds, 2) for i, q in asked}
    assert {r.question_id: (r.answer, r.rounds, r.open) for r in got.collect()} == want
    assert rounds == 1 or want[1][1] > 1 and want[1][2] is None and want[2][1] == 3 and want[2][2]


def test_rounds_with_the_rule_model_and_no_questions(spark):
    nodes = spark.createDataFrame([("a", "Berlin is old. It grew.", "text", [1.0] * 8)], "node_id string, text string, modality string, embedding array<float>")
    search = lambda q, k: retrieval.nearest(nodes, q, {None: k})
    p = Providers(HashedEmbedding(8))
    none = spark.createDataFrame([], "question_id string, text string")
    assert iterate.answer_all(spark, none, search, nodes, p).collect() == []
    one = iterate.answer_all(spark, spark.createDataFrame([("q", "When?")], "question_id string, text string"), search, nodes, p).first()
    assert one.question_id == "q" and "Berlin" in one.answer and one.rounds == 3 and one.open
