"""A live wiki as a data source: pages by title, search or range of titles, and pages as they change.

    register(spark)
    spark.read.format("wiki").option("url", api).load().where("title = 'Berlin'")
    spark.read.format("wiki").option("search", "history of berlin").option("results", 2).load()
    spark.readStream.format("wiki").option("start", "2024-01-01T00:00:00Z").load()

A filter on title is pushed to the source and asks for these pages alone.  Without one the titles are
read by ranges, a partition for each, which lists its titles and reads their pages as rows are asked for; so a limit
ends the reading early, and no list of titles comes to the driver.  A stream's offset is the time of the
last change it has read; a batch holds the pages that changed up to `batch` changes on."""

from __future__ import annotations

import json
import logging
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

from quern import schema

#: Taken where no other address is given, or the one given does not answer.
DEFAULT_URL = "https://en.wikipedia.org/w/api.php"
#: Where ranges of titles begin, if the option `bounds` does not say: each letter is a partition.
BOUNDS = "".join(chr(c) for c in range(ord("A"), ord("Z") + 1))


@dataclass(frozen=True)
class WikiClient:
    """The wiki's API, as far as pages need it."""

    url: str = DEFAULT_URL
    agent: str = "quern"
    html: bool = False
    images: bool = False
    tries: int = 3
    wait: float = 1.0

    def get(self, **params) -> dict:
        where = f"{self.url}?{urllib.parse.urlencode(params | {'format': 'json', 'formatversion': 2})}"
        call = urllib.request.Request(where, headers={"User-Agent": self.agent})
        for n in range(self.tries):
            try:
                with urllib.request.urlopen(call, timeout=30) as answer:
                    return json.load(answer)
            except (OSError, ValueError):
                if n == self.tries - 1:
                    raise
                time.sleep(self.wait * 2**n)
        raise OSError("not tried")

    def listed(self, name: str, params: dict) -> Iterator[dict]:
        """Every entry of a list, request by request as they are asked for."""
        more: dict = {}
        while True:
            got = self.get(action="query", list=name, **params, **more)
            yield from got.get("query", {}).get(name, [])
            more = got.get("continue") or {}
            if not more:
                return

    def titles(self, low: str | None, high: str | None) -> Iterator[str]:
        """Titles from low on, before high."""
        for e in self.listed("allpages", {"aplimit": "max"} | ({"apfrom": low} if low else {}) | ({"apto": high} if high else {})):
            if high is None or e["title"] < high:
                yield e["title"]

    def search(self, query: str, results: int) -> list[str]:
        if not query.strip() or results < 1:
            return []
        got = self.get(action="query", list="search", srsearch=query, srlimit=results)
        return [e["title"] for e in got.get("query", {}).get("search", [])][:results]

    def suggestions(self, query: str, results: int = 3) -> list[str]:
        """Titles that the wiki itself thinks are meant."""
        got = self.get(action="opensearch", search=query, limit=results)
        return list(got[1])[:results] if isinstance(got, list) else []

    def changes(self, start: str, end: str | None = None, most: int | None = None) -> list[tuple[str, str]]:
        """(time, title) of changes after `start`, up to `end`, the oldest first; `most` or some more, as
        changes of one time are not parted."""
        out: list[tuple[str, str]] = []
        for e in self.listed("recentchanges", {"rcstart": start, "rcdir": "newer", "rcprop": "title|timestamp", "rclimit": min(most or 500, 500)} | ({"rcend": end} if end else {})):
            if e["timestamp"] <= start:
                continue
            if most and len(out) >= most and e["timestamp"] != out[-1][0]:
                break
            out.append((e["timestamp"], e["title"]))
        return out

    def page(self, title: str) -> tuple | None:
        """A row of PAGE_SCHEMA, or None where there is no such page.  One request, and one more each for
        html and images where they are wanted."""
        found = self.get(action="query", prop="extracts|categories", explaintext=1, cllimit="max", titles=title).get("query", {}).get("pages", [])
        if not found or found[0].get("missing") or "pageid" not in found[0]:
            return None
        p = found[0]
        content = p.get("extract") or ""
        categories = [c["title"].partition(":")[2] or c["title"] for c in p.get("categories", [])]
        html = self.get(action="parse", page=p["title"], prop="text").get("parse", {}).get("text", "") if self.html else ""
        images = []
        if self.images:
            files = self.get(action="query", generator="images", titles=p["title"], gimlimit="max", prop="imageinfo", iiprop="url").get("query", {}).get("pages", [])
            images = [(None, f["title"].partition(":")[2], f["imageinfo"][0]["url"]) for f in files if f.get("imageinfo")]
        return (str(p["pageid"]), p["title"], content, content.split("\n==")[0].strip(), categories, html, images, None)


def reached(client: WikiClient) -> WikiClient:
    """The client, or one of the default address where the given one does not answer."""
    if client.url == DEFAULT_URL:
        return client
    try:
        client.get(action="query", meta="siteinfo")
        return client
    except (OSError, ValueError) as error:
        logging.getLogger("quern").error("%s does not answer, %s is taken: %s", client.url, DEFAULT_URL, error)
        return WikiClient(DEFAULT_URL, client.agent, client.html, client.images, client.tries, client.wait)


@dataclass
class Titles(InputPartition):
    """Pages of some titles."""

    titles: tuple[str, ...]

    def __post_init__(self):
        super().__init__(self.titles)


@dataclass
class Range(InputPartition):
    """Pages of all titles from low on, before high."""

    low: str | None
    high: str | None

    def __post_init__(self):
        super().__init__((self.low, self.high))


def _parts(titles: list[str], size: int) -> list[Titles]:
    own = list(dict.fromkeys(titles))
    return [Titles(tuple(own[i : i + size])) for i in range(0, len(own), size)] or [Titles(())]


def _client(options) -> WikiClient:
    flag = lambda k: str(options.get(k, "false")).lower() == "true"
    return WikiClient((options.get("url") or "").strip() or DEFAULT_URL, options.get("agent") or "quern", flag("html"), flag("images"), int(options.get("tries", 3)), float(options.get("wait", 1.0)))


class _Pages:
    """Reading partitions, which both readers do alike."""

    client: WikiClient

    def read(self, partition):
        if isinstance(partition, Range):
            titles = self.client.titles(partition.low, partition.high)
        else:
            titles = iter(partition.titles)
        for title in titles:
            row = self.client.page(title)
            if row is not None:
                yield row


class WikiReader(_Pages, DataSourceReader):
    def __init__(self, options):
        self.options, self.client = options, _client(options)
        self.wanted: set[str] | None = None
        self.size = int(options.get("pages", 50))

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("title",):
                these = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = these if self.wanted is None else self.wanted & these
            yield f  # Spark looks again

    def partitions(self):
        self.client = reached(self.client)
        if self.wanted is not None:
            return _parts(sorted(t for t in self.wanted if t is not None), self.size)
        if self.options.get("search") is not None:
            return _parts(self.client.search(self.options["search"], int(self.options.get("results", 10))), self.size)
        bounds = [b for b in (self.options.get("bounds") or ",".join(BOUNDS)).split(",") if b]
        return [Range(a, z) for a, z in zip([None, *bounds], [*bounds, None])]


class WikiStreamReader(_Pages, DataSourceStreamReader):
    def __init__(self, options):
        self.client = reached(_client(options))
        self.start = options.get("start") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        self.size, self.batch = int(options.get("pages", 50)), int(options.get("batch", 500))
        self.at: str | None = None

    def initialOffset(self) -> dict:
        return {"time": self.start}

    def latestOffset(self) -> dict:
        """The time of the last of `batch` changes after what has been read."""
        at = self.at or self.start
        found = self.client.changes(at, most=self.batch)
        self.at = found[-1][0] if found else at
        return {"time": self.at}

    def partitions(self, start: dict, end: dict):
        self.at = max(end["time"], self.at or "")
        return _parts([t for _, t in self.client.changes(start["time"], end["time"])], self.size)

    def commit(self, end: dict) -> None:
        return


class WikiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self):
        return schema.PAGE_SCHEMA

    def reader(self, schema) -> WikiReader:
        return WikiReader(self.options)

    def streamReader(self, schema) -> WikiStreamReader:
        return WikiStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format `wiki` known to a session, and let it take filters (spark.sql.python.filterPushdown.enabled)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WikiSource)


def page(spark: SparkSession, title: str, **options) -> DataFrame:
    """The live page of a title; no row if it is missing."""
    from pyspark.sql import functions as F

    register(spark)
    return spark.read.format("wiki").options(**options).load().where(F.col("title") == title)
