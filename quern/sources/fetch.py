"""Fetching by url, as a job: each distinct url once, a limit of calls at a time for each host, failures apart.

Urls are dealt to lanes, PER_HOST of them for each host, and lanes to tasks; a lane makes one call after
another, so no host ever has more calls open than lanes, wherever its urls came from and however many they are.  A
task has calls of several lanes in flight; what it fetched goes on as it comes."""

from __future__ import annotations

import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import images, text
from quern.sources.store import load_stage, save_stage

#: Calls that a host has open at most; calls of a task at a time; rows that wait for an earlier one.
PER_HOST, IN_FLIGHT, AHEAD = 4, 16, 64


class Missing(Exception):
    """There is nothing at this url, and there will not be: no second try."""


@dataclass(frozen=True)
class HttpGet:
    """The bytes at a url."""

    agent: str = "quern"
    timeout: float = 30
    most_bytes: int = 50 << 20

    def __call__(self, url: str) -> bytes:
        call = urllib.request.Request(url, headers={"User-Agent": self.agent})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                data = answer.read(self.most_bytes + 1)
        except urllib.error.HTTPError as error:
            if 400 <= error.code < 500 and error.code not in (408, 429):
                raise Missing(f"status {error.code}") from error
            raise OSError(f"status {error.code}") from error
        except ValueError as error:
            raise Missing(str(error)) from error
        if len(data) > self.most_bytes:
            raise Missing(f"more than {self.most_bytes} bytes")
        return data


def host(url):
    """The host of a url, lower case, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _tried(fetch: Callable[[str], bytes], url: str, tries: int, wait: float, sleep=time.sleep) -> tuple[bytes | None, str | None, int]:
    """(data, error, tries)."""
    for n in range(1, tries + 1):
        try:
            return fetch(url), None, n
        except Missing as error:
            return None, str(error), n
        except Exception as error:  # whatever a fetcher says: the url is kept with it
            if n == tries:
                return None, f"{type(error).__name__}: {error}", n
            sleep(wait * 2 ** (n - 1))
    return None, "not tried", 0


class Lanes:
    """Calls in a pool, of each lane one after another: a lane that has one open keeps no thread waiting."""

    def __init__(self, pool: ThreadPoolExecutor, call: Callable):
        self.pool, self.call = pool, call
        self.lock, self.waiting = threading.Lock(), {}

    def submit(self, lane: str, *args) -> Future:
        out: Future = Future()
        with self.lock:
            if lane in self.waiting:
                self.waiting[lane].append((out, args))
                return out
            self.waiting[lane] = deque()
        self.pool.submit(self._work, lane, out, args)
        return out

    def _work(self, lane: str, out: Future, args: tuple) -> None:
        try:
            out.set_result(self.call(*args))
        except BaseException as error:  # handed on to whoever asks for the result
            out.set_exception(error)
        with self.lock:
            if not self.waiting[lane]:
                del self.waiting[lane]
                return
            then = self.waiting[lane].popleft()
        self.pool.submit(self._work, lane, *then)


def fetched(urls: DataFrame, fetch: Callable[[str], bytes] | None = None, url_col: str = "url", per_host: int = PER_HOST, in_flight: int = IN_FLIGHT, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(url, host, data, error, tries): each distinct url of urls, once; data is null where error is not.
    Null urls are left out.  Write it before it is used twice: it is the fetching itself."""
    packed = cloudpickle.dumps(fetch or HttpGet())
    own = urls.select(F.col(f"`{url_col}`").alias("url")).where("url is not null").distinct()
    lanes = own.withColumn("host", host(F.col("url"))).withColumn("lane", F.concat_ws("#", "host", F.pmod(F.xxhash64("url"), F.lit(per_host))))
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # in a task lanes are mixed, so that a slow host's urls do not stand in a row
    dealt = lanes.repartition(parts, "lane").sortWithinPartitions(F.xxhash64("url", F.lit(1)))

    def run(batches):
        get = cloudpickle.loads(packed)

        def row(url, own_host, future):
            data, error, n = future.result()
            return pa.RecordBatch.from_arrays([pa.array([url]), pa.array([own_host]), pa.array([data], pa.binary()), pa.array([error], pa.string()), pa.array([n], pa.int32())], names=["url", "host", "data", "error", "tries"])

        pending: deque = deque()
        with ThreadPoolExecutor(in_flight) as pool:
            calls = Lanes(pool, lambda url: _tried(get, url, tries, wait))
            for b in batches:
                for url, own_host, lane in zip(*[c.to_pylist() for c in b.columns]):
                    pending.append((url, own_host, calls.submit(lane, url)))
                    while len(pending) > AHEAD or pending and pending[0][2].done():
                        yield row(*pending.popleft())
            while pending:
                yield row(*pending.popleft())

    return dealt.mapInArrow(run, "url string, host string, data binary, error string, tries int")


def fetch_images(urls: DataFrame, path: str, fetch: Callable[[str], bytes] | None = None, url_col: str = "url", **how) -> tuple[DataFrame, DataFrame]:
    """(images, failures), both from one fetching that is written at a path: images (image_url, image_name,
    image_data), made PNG; failures (url, host, error, tries), with what could be fetched but is no
    image that can be read."""
    save_stage(fetched(urls, fetch, url_col, **how), f"{path}/fetched")
    got = load_stage(urls.sparkSession, f"{path}/fetched")
    made = got.withColumn("png", images.page_images("data"))
    save_stage(made.select("url", "host", "png", F.when(F.col("error").isNull() & F.col("png").isNull(), F.lit("no image that can be read")).otherwise(F.col("error")).alias("error"), "tries"), f"{path}/images")
    done = load_stage(urls.sparkSession, f"{path}/images")
    rows = done.where("error is null").select(F.col("url").alias("image_url"), text.url_name(F.col("url")).alias("image_name"), F.col("png").alias("image_data"))
    return rows, done.where("error is not null").select("url", "host", "error", "tries")


def with_images(pages: DataFrame, path: str, fetch: Callable[[str], bytes] | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(pages, failures): pages whose images have their data, fetched where only a url is given; images that
    can't be had are left out, as they are in the list of failures."""
    each = pages.select("page_id", F.posexplode("images").alias("pos", "image"))
    lacking = each.where("image.image_data is null and image.image_url is not null").select(F.col("image.image_url").alias("url"))
    found, failures = fetch_images(lacking, path, fetch, **how)
    found = found.select(F.col("image_url").alias("url"), F.col("image_data").alias("png"), "image_name")
    both = each.join(found, F.col("image.image_url") == F.col("url"), "left")
    data = F.coalesce("image.image_data", "png")
    kept = both.withColumn("new", F.struct(data.alias("image_data"), F.coalesce("image.image_name", "image_name").alias("image_name"), F.col("image.image_url").alias("image_url")))
    kept = kept.where(data.isNotNull()).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("have"))
    out = pages.drop("images").join(kept.select("page_id", F.transform("have", lambda x: x["new"]).alias("images")), "page_id", "left")
    kind = pages.schema["images"].dataType
    return out.withColumn("images", F.coalesce(F.col("images").cast(kind), F.array().cast(kind))).select(*pages.columns), failures
