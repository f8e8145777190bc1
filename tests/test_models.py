"""Model calls that overlap, structured entities, counters, kept connections."""

import json
import sys
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quern import providers as pr
from quern import schema
from quern.operators import asking, counting, derive
from quern.providers import Answer, Busy, ChatModel, Filtered, HashedEmbedding, HashedPixels, JsonClient, Oversize, Providers, Request, RuleText

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Slow:
    """A tenth of a second for each call; says who called, and what a text asks it to do."""

    def answer(self, request):
        time.sleep(0.1)
        text = request.text or ""
        if text.startswith("refuse"):
            raise Filtered
        return Answer(f"{request.stage}: {text}", len(text))


def nodes(spark, texts, kind="section"):
    rows = [(f"n{i:03d}", f"p{i % 3}", "text", kind, f"T{i}", t, "about", "src", i) for i, t in enumerate(texts)]
    return schema.as_nodes(spark.createDataFrame(rows, "node_id string, page_id string, kind string, type string, title string, text string, context string, source_id string, ord long"))


def test_calls_overlap_and_keep_their_order():
    """32 calls of 100 ms in under a second, on one core."""
    began = time.perf_counter()
    with ThreadPoolExecutor(32) as pool:
        call = lambda i: asking.one(Slow(), Request("summary", f"t{i}"), None, None, asking.Gate(0))
        out = list(asking.in_order(pool, iter([[(i,) for i in range(20)], [], [(i,) for i in range(20, 32)]]), call))
    assert time.perf_counter() - began < 1.0
    assert [[r[0] for r in b] for b in out] == [[f"summary: t{i}" for i in range(20)], [], [f"summary: t{i}" for i in range(20, 32)]]


def test_a_stage_calls_many_at_once(spark):
    """64 sections of one task, and the seconds between its first call and its last answer."""

    class Timed(Slow):
        def answer(self, request):
            began = time.time()
            return Answer(f"{began} {super().answer(request).text} {time.time()}", 1)

    made = derive.summaries(nodes(spark, [f"s{i}" for i in range(64)]).coalesce(1), Providers(text=Timed()), only_new=True).collect()
    took = [r.text.split(" ") for r in made]
    assert [t[2] for t in took] == [f"s{i}" for i in range(64)]
    assert max(float(t[3]) for t in took) - min(float(t[0]) for t in took) < 2.0


def test_a_retry_holds_back_its_own_call_only():
    tries = {}

    class Flaky:
        def answer(self, request):
            tries[request.text] = tries.get(request.text, 0) + 1
            if request.text == "t0" and tries["t0"] < 3:
                raise Busy
            done.append(request.text)
            return Answer(request.text)

    done = []
    wait = lambda call: pr.retrying(call, low=0.3, high=0.31)
    with ThreadPoolExecutor(4) as pool:
        out = list(asking.in_order(pool, iter([[(i,) for i in range(12)]]), lambda i: asking.one(Flaky(), Request("summary", f"t{i}"), None, None, asking.Gate(0), wait)))
    assert [r[0] for r in out[0]] == [f"t{i}" for i in range(12)] and done[-1] == "t0" and tries["t0"] == 3


def test_the_pace_is_shared():
    times, now = [], [0.0]
    gate = asking.Gate(0.5, lambda: now[0], times.append)
    [gate.wait() for _ in range(4)]
    assert times == [0.5, 1.0, 1.5]
    now[0] = 10.0
    gate.wait()
    assert len(times) == 3


def test_oversize_refused_and_unsound_answers():
    class Picky:
        def __init__(self):
            self.seen = []

        def answer(self, request):
            self.seen.append(request.image or request.text)
            if request.image and len(request.image) > 4:
                raise Oversize
            if request.text == "no":
                raise Filtered
            return Answer("bad" if len(self.seen) < 2 else "good", 3)

    ask = lambda model, r, **k: asking.one(model, r, k.get("smaller"), k.get("sound"), asking.Gate(0))
    assert ask(Picky(), Request("image_description", image=b"large image"), smaller=lambda d: d[:4]) == ("good", 3, 1)
    with pytest.raises(Oversize):
        ask(Picky(), Request("image_description", image=b"large image"))
    assert ask(Picky(), Request("summary", "no")) == (None, 0, 1) and ask(Picky(), None) == (None, 0, 0)
    assert ask(Picky(), Request("summary", "x"), sound="good".__eq__) == ("good", 6, 2)


class Structured:
    """Entities as asked for, but broken the first time for some texts and always for others."""

    def __init__(self):
        self.calls = {}

    def answer(self, request):
        n = self.calls[request.text] = self.calls.get(request.text, 0) + 1
        whole = {"persons": [{"name": "Ada", "context": request.text}, {"name": " ada "}], "organizations": [], "locations": [{"name": "Rome", "context": "in Rome"}], "dates": []}
        if request.text == "never" or request.text == "once" and n == 1:
            return Answer('{"persons": [', 5)
        if request.text == "half":
            return Answer(json.dumps({"persons": [], "dates": []}), 5)
        return Answer(json.dumps(whole), 7)


def test_entities_are_rows_and_broken_answers_are_kept_apart(spark):
    counters = counting.Counters()
    p = Providers(text=Structured(), counters=counters)
    held = derive.entity_answers(nodes(spark, ["fine", "once", "never", "half", None]).coalesce(1), p).cache()
    assert {(r.node_id, r.tries, r.sound) for r in held.collect()} == {("n000", 1, True), ("n001", 2, True), ("n002", 2, False), ("n003", 2, False), ("n004", 0, False)}
    assert {(r.node_id, r.answer[:11]) for r in derive.broken_answers(held).collect()} == {("n002", '{"persons":'), ("n003", '{"persons":')}
    found = derive.mentions(held)
    assert {(r.kind, r["name"], r.node_id, r.page_id) for r in found.collect()} == {("person", "Ada", "n000", "p0"), ("location", "Rome", "n000", "p0"), ("person", "Ada", "n001", "p1"), ("location", "Rome", "n001", "p1")}
    assert {(r.kind, r["name"], r.sections, r.pages) for r in derive.entity_table(found).collect()} == {("person", "Ada", 2, 2), ("location", "Rome", 2, 2)}
    assert counters.settle()["entity_rows"] == {"asked": 4, "again": 3, "refused": 0, "unusable": 0, "tokens": 7 + 12 + 10 + 10} and abs(counters.cost() - 39 * 0.00002) < 1e-12
    held.unpersist()


def test_rule_entities():
    got = json.loads(RuleText().complete(Request("entity_rows", "Ada Byron met Babbage from Acme Company in Paris in 1843. Paris, 1843!")))
    assert got == {"persons": [{"name": "Ada Byron", "context": "Ada Byron"}, {"name": "Babbage", "context": "Babbage"}, {"name": "Paris", "context": "Paris"}], "organizations": [], "locations": [{"name": "Acme Company", "context": "from Acme Company"}, {"name": "Paris", "context": "in Paris"}], "dates": [{"name": "1843", "context": "1843"}]}


def test_counters_of_a_batch_take_one_pass(spark, tmp_path):
    """Nodes by type, refusals, tokens; each text is asked about once."""
    path = tmp_path / "calls"

    class Counted(Slow):
        def answer(self, request):
            with open(path, "a") as f:
                f.write("x")
            return super().answer(request)

    counters = counting.Counters()
    p = Providers(text=Counted(), counters=counters)
    rows = nodes(spark, ["aa", "bbb", "refuse", None, "cccc"])
    made = derive.summaries(rows, p)
    counters.nodes(made).write.parquet(str(tmp_path / "out"))
    seen = counters.settle()
    assert path.read_text() == "xxxx"
    assert seen["summary"] == {"asked": 4, "again": 0, "refused": 1, "unusable": 0, "tokens": 9}
    assert (seen["nodes"]["all"], seen["nodes"]["section"], seen["nodes"]["summary"], seen["nodes"]["other"]) == (8, 5, 3, 0)
    counters.nodes(rows.limit(0)).count()
    assert counters.settle()["nodes"]["all"] == 8 and counters.tokens() == 9


def test_counters_of_a_stream(spark, tmp_path):
    from test_engine import pages

    from quern.config import StoreConfig
    from quern.sources.store import GraphStore
    from quern.streaming.ingest import ingest_stream, page_stream

    source = str(tmp_path / "in")
    pages(spark, 2).write.parquet(source)
    counters, listener = counting.Counters(), counting.PageListener()
    spark.streams.addListener(listener)
    try:
        graph = GraphStore(spark, StoreConfig(path=str(tmp_path / "g")))
        ingest_stream(page_stream(spark, source), graph, str(tmp_path / "cp"), Providers(HashedEmbedding(8), counters=counters), once=True).awaitTermination()
        until = time.time() + 10
        while listener.pages < 2 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.pages == 2 and listener.bytes > 300 and listener.failed is None
    seen = counters.settle()
    types = {r["type"]: r["count"] for r in graph.nodes().groupBy("type").count().collect()}
    assert seen["nodes"]["all"] == sum(types.values()) and all(seen["nodes"][t.replace("-", "_")] == n for t, n in types.items())
    assert seen["summary"]["asked"] == types["section"] + types["subsection"]


def test_embedding_calls_are_parts_in_order(spark):
    class Parts(HashedEmbedding):
        batch = 3

        def embed(self, texts):
            assert len(texts) <= 3
            return super().embed(texts)

    rows = nodes(spark, [f"text {i}" for i in range(20)] + [None]).withColumn("needs_embedding", F.lit(True))
    got = {r.node_id: r.embedding for r in derive.embedded(rows, Providers(Parts(8), images=HashedPixels(4))).select("node_id", "embedding").collect()}
    want = HashedEmbedding(8).embed([f"text {i}" for i in range(20)] + [""])
    assert all(got[f"n{i:03d}"] == [float(x) for x in want[i]] for i in range(21))


class _Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, self.client_address[1], body, self.headers.get("api-key")))
        status, raw = 200, json.dumps({"vector": [1.0, 2.0]} if "image" in body else {"choices": [{"message": {"content": "hi"}}], "usage": {"total_tokens": 4}}).encode()
        if body.get("image") == "YmFk":
            status, raw = 400, b"no json"
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        if len(self.seen) == 2:
            self.send_header("Connection", "close")
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        return


def test_connections_are_kept_and_opened_again():
    import pickle

    server = ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/chat?v=1"
    try:
        model = pickle.loads(pickle.dumps(ChatModel(url, "k", JsonClient(5))))
        assert [model.answer(Request("entity_rows", "x")) for _ in range(4)] == [Answer("hi", 4)] * 4
        seen = _Handler.seen
        assert {(s[0], s[3]) for s in seen} == {("/chat?v=1", "k")} and len({s[1] for s in seen}) == 2
        assert seen[0][2]["top_p"] == 0.95 and seen[0][2]["function_call"] == {"name": "entities"} and set(seen[0][2]["functions"][0]["parameters"]["properties"]) == set(pr.ENTITY_KINDS)
        vectors = pr.RemoteImageEmbedding(url, 2, send=JsonClient(5)).embed_images([b"png", b"bad"])
        assert vectors[0].tolist() == [1.0, 2.0] and vectors[1] is None
    finally:
        server.shutdown()
        server.server_close()
    with pytest.raises(OSError):
        JsonClient(1)(url, {}, {})


def test_function_answers_are_arguments():
    said = {"choices": [{"message": {"content": None, "function_call": {"name": "entities", "arguments": '{"persons": []}'}}}], "usage": {"total_tokens": 9}}
    assert ChatModel("u", send=lambda *a: (200, said)).answer(Request("entity_rows", "x")) == Answer('{"persons": []}', 9)
