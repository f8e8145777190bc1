"""The live source against a local wiki, fetching with a fake fetcher."""

import json
import struct
import sys
import threading
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quern import schema
from quern.sources import fetch, live

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests



def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0"


PAGES = {f"{a}{i:02d}": f"About {a}{i}.\n== One ==\nBody of {a}{i}." for a in "ABCM" for i in range(12)}
CHANGES = [(f"2024-01-0{1 + i // 3}T00:00:0{i % 3 // 2}Z", t) for i, t in enumerate(["A01", "A02", "B01", "A01", "C05", "gone", "M03", "B02"])]


class Wiki(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query).items()}
        self.asked.append(q)
        out: object = {}
        if q.get("list") == "allpages":
            own = [t for t in sorted(PAGES) if t >= q.get("apcontinue", q.get("apfrom", "")) and t <= q.get("apto", "~")]
            out = {"query": {"allpages": [{"title": t} for t in own[:5]]}} | ({"continue": {"apcontinue": own[5]}} if len(own) > 5 else {})
        elif q.get("list") == "search":
            out = {"query": {"search": [{"title": t} for t in sorted(PAGES) if q["srsearch"] in PAGES[t]]}}
        elif q.get("list") == "recentchanges":
            own = [c for c in CHANGES if c[0] >= q["rcstart"] and c[0] <= q.get("rcend", "~")]
            at = int(q.get("rccontinue", 0))
            out = {"query": {"recentchanges": [{"timestamp": a, "title": t} for a, t in own[at : at + 2]]}} | ({"continue": {"rccontinue": at + 2}} if at + 2 < len(own) else {})
        elif q["action"] == "opensearch":
            out = [q["search"], ["A01", "A02", "A03", "A04"]]
        elif q["action"] == "parse":
            out = {"parse": {"text": f"<p>{q['page']}</p>"}}
        elif q.get("generator") == "images":
            out = {"query": {"pages": [{"title": "File:map.png", "imageinfo": [{"url": "http://i/map.png"}]}, {"title": "File:none.png"}]}}
        elif q.get("prop", "").startswith("extracts"):
            t = q["titles"]
            out = {"query": {"pages": [{"title": t, "missing": True} if t not in PAGES else {"pageid": sorted(PAGES).index(t), "title": t, "extract": PAGES[t], "categories": [{"title": "Category:letters"}]}]}}
        raw = json.dumps(out).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def log_message(self, *args):
        return


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Wiki)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/api"
    server.shutdown()
    server.server_close()


@pytest.fixture
def asked():
    Wiki.asked.clear()
    return Wiki.asked


def test_a_title_makes_one_request_for_its_page(spark, url, asked):
    row = live.page(spark, "B03", url=url).collect()
    assert [(r.title, r.content, r.summary, r.categories, r.html, r.images) for r in row] == [("B03", PAGES["B03"], "About B3.", ["letters"], "", [])]
    assert [q["titles"] for q in asked if "titles" in q] == ["B03"] and not [q for q in asked if q.get("list")]
    asked.clear()
    live.register(spark)
    rows = spark.read.format("wiki").options(url=url, html="true", images="true").load().where(F.col("title").isin("A01", "C02", "no such page"))
    assert {(r.title, r.html, tuple(map(tuple, r.images))) for r in rows.collect()} == {(t, f"<p>{t}</p>", ((None, "map.png", "http://i/map.png"),)) for t in ("A01", "C02")}
    assert sorted(q["titles"] for q in asked if q.get("prop", "").startswith("extracts")) == ["A01", "C02", "no such page"]


def test_all_titles_by_ranges(spark, url, asked):
    live.register(spark)
    pages = spark.read.format("wiki").options(url=url, bounds="B,C,N").load()
    assert pages.schema == schema.PAGE_SCHEMA and pages.rdd.getNumPartitions() == 4
    rows = pages.select("title", "content").collect()
    assert sorted((r.title, r.content) for r in rows) == sorted(PAGES.items())
    asked.clear()
    assert len(pages.where("content like 'About A%'").limit(2).collect()) == 2
    assert len([q for q in asked if "titles" in q]) < len(PAGES)


def test_search_and_suggestions(spark, url):
    live.register(spark)
    rows = spark.read.format("wiki").options(url=url, search="Body of C1", results=2).load().collect()
    assert [r.title for r in rows] == ["C01", "C10"]
    client = live.WikiClient(url)
    assert client.search(" ", 3) == [] and client.search("Body", 0) == [] and client.suggestions("a1", 3) == ["A01", "A02", "A03"]
    assert spark.read.format("wiki").options(url=url, search="nothing like it").load().count() == 0


def test_an_address_that_does_not_answer_gives_way_to_the_default(url, monkeypatch):
    monkeypatch.setattr(live, "DEFAULT_URL", url)
    assert live.reached(live.WikiClient("http://127.0.0.1:9/none", tries=1)).url == url
    assert live.reached(live.WikiClient(url + "/own", tries=1)).url == url + "/own"


def test_changes_as_a_stream(spark, url, tmp_path):
    """Every changed page, each batch by offsets; a second run goes on where the first has ended."""
    assert [t for _, t in live.WikiClient(url).changes("2024-01-01T00:00:00Z", most=1)] == ["B01"]
    live.register(spark)
    got = []

    def run():
        stream = spark.readStream.format("wiki").options(url=url, start="2023-12-31T00:00:00Z", batch=2, pages=1).load()
        query = stream.writeStream.foreachBatch(lambda b, n: got.append(sorted(r.title for r in b.select("title").collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    seen = [t for b in got for t in b]
    assert set(seen) == {"A01", "A02", "B01", "C05", "M03", "B02"} and len(got) >= 3
    before = len([b for b in got if b])
    run()
    assert len([b for b in got if b]) == before


class Fake:
    """Says when it was called; some urls fail for good, some once, some are slow."""

    def __init__(self, path):
        self.path = path

    def __call__(self, url):
        with open(self.path, "a") as f:
            f.write(f"+{url}\n")
        time.sleep(0.2 if "slow" in url else 0.02)
        with open(self.path, "a") as f:
            f.write(f"-{url}\n")
        if "missing" in url:
            raise fetch.Missing("status 404")
        if "busy" in url:
            with open(self.path) as f:
                if f.read().count(f"+{url}\n") < 2:
                    raise OSError("status 503")
        if "broken" in url:
            raise OSError("status 500")
        return b"no image" if "text" in url else png(60, 60)


def test_fetching_once_each_by_host_with_failures_apart(spark, tmp_path):
    log = tmp_path / "calls"
    names = [f"http://slow.org/{i}.png" for i in range(12)] + [f"http://User@Fast{h}.org:80/{i}.png" for h in range(3) for i in range(10)]
    names += ["http://fast0.org/missing.png", "http://fast0.org/busy.png", "http://fast1.org/broken.png", "http://fast1.org/text.png", "no url", None]
    rows = [(u, 1, "h") for u in names * 3]
    df = spark.createDataFrame(rows, "url string, data int, host string").repartition(4)
    made, failed = fetch.fetch_images(df, str(tmp_path / "out"), Fake(str(log)), per_host=2, tries=2, wait=0.01)
    calls = log.read_text().splitlines()
    starts = [c[1:] for c in calls if c[0] == "+"]
    assert all(starts.count(u) == (2 if "b" in u.split("/")[-1][:1] else 1) for u in set(names) - {None})
    open_ = most = 0
    for c in calls:
        if "slow.org" in c:
            open_ += 1 if c[0] == "+" else -1
            most = max(most, open_)
    assert 1 <= most <= 2
    assert made.count() + failed.count() == len(set(names)) - 1
    bad = {r.url: (r.host, r.error, r.tries) for r in failed.collect()}
    assert bad["http://fast0.org/missing.png"] == ("fast0.org", "status 404", 1) and bad["http://fast1.org/broken.png"] == ("fast1.org", "OSError: status 500", 2)
    assert bad["http://fast1.org/text.png"] == ("fast1.org", "no image that can be read", 1) and "no url" not in bad or bad["no url"][0] == ""
    good = {r.image_url: r for r in made.collect()}
    assert good["http://slow.org/3.png"].image_name == "3" and good["http://fast0.org/busy.png"].image_data[:4] == b"\x89PNG"


def test_a_busy_lane_keeps_no_other_waiting():
    from concurrent.futures import ThreadPoolExecutor

    done = []

    def call(name):
        time.sleep(0.3 if name == "slow" else 0.01)
        done.append(name)

    with ThreadPoolExecutor(2) as pool:
        lanes = fetch.Lanes(pool, call)
        out = [lanes.submit("a", "slow") for _ in range(3)] + [lanes.submit(f"b{i}", f"b{i}") for i in range(10)]
        [f.result() for f in out]
    assert done[:10] == [f"b{i}" for i in range(10)] and done[10:] == ["slow"] * 3
    with ThreadPoolExecutor(2) as pool, pytest.raises(ZeroDivisionError):
        fetch.Lanes(pool, lambda x: 1 / x).submit("a", 0).result()


def test_pages_get_the_images_that_have_a_url_only(spark, tmp_path):
    kind = schema.PAGE_SCHEMA["images"].dataType.simpleString()
    rows = [("p1", [(None, None, "http://x.org/a.png"), (png(55, 55), "own", "http://x.org/b.png"), (None, "n", "http://x.org/missing.png")]), ("p2", [(None, "again", "http://x.org/a.png")]), ("p3", []), ("p4", None)]
    pages = spark.createDataFrame(rows, f"page_id string, images {kind}")
    out, failed = fetch.with_images(pages, str(tmp_path / "o"), Fake(str(tmp_path / "calls")))
    got = {r.page_id: [(i.image_name, i.image_data is not None) for i in r.images] for r in out.collect()}
    assert got == {"p1": [("a", True), ("own", True)], "p2": [("again", True)], "p3": [], "p4": []}
    assert [r.url for r in failed.collect()] == ["http://x.org/missing.png"] and (tmp_path / "calls").read_text().count("+") == 2
