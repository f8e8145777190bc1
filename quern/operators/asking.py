"""Questions to models from rows: several in flight at once, answers in the order of the rows.

A worker has one client for each provider, however many tasks it runs, and a pool of threads that call
it.  A call that has to wait (a refused rate, a passing failure) waits in its own thread; the others go
on, and so do those of the next Arrow batch.  The pace is shared: calls of one worker start through one gate,
and the rate asked for is divided among all places that tasks may run at."""

from __future__ import annotations

import hashlib
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.batches import bounded, series
from quern.providers import Answer, Oversize, Request, answered, retrying

#: What a stage gets for each row; tries is 0 where nothing was asked.
ANSWER = "answer string, tokens long, tries int"


@dataclass(frozen=True)
class Pace:
    """Calls that a worker has in flight, and calls a second of all workers together (None: any)."""

    in_flight: int = 32
    per_second: float | None = None


class Gate:
    """Lets callers through one after another, `gap` seconds apart at least."""

    def __init__(self, gap: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = gap, clock, sleep
        self.lock, self.next = threading.Lock(), 0.0

    def wait(self) -> None:
        if self.gap <= 0:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


_clients: dict[str, tuple] = {}
_making = threading.Lock()


def _client(packed: bytes, in_flight: int, gap: float) -> tuple:
    """(what was packed, pool, gate): one for each worker."""
    key = hashlib.sha256(packed).hexdigest() + f"|{in_flight}|{gap}"
    with _making:
        if key not in _clients:
            _clients[key] = (cloudpickle.loads(packed), ThreadPoolExecutor(in_flight), Gate(gap))
        return _clients[key]


def in_order(pool: ThreadPoolExecutor, batches: Iterator[list], call: Callable, ahead: int = 1) -> Iterator[list]:
    """call(*row) for all rows of all batches, results by batch and in order; up to `ahead` batches are
    under way while an earlier one is waited for."""
    pending: deque[list[Future]] = deque()
    for rows in batches:
        pending.append([pool.submit(call, *row) for row in rows])
        if len(pending) > ahead:
            yield [f.result() for f in pending.popleft()]
    while pending:
        yield [f.result() for f in pending.popleft()]


def one(provider, request: Request | None, smaller: Callable[[bytes], bytes | None] | None, sound: Callable[[str], bool] | None, gate: Gate, retry=retrying) -> tuple[str | None, int, int]:
    """(answer, tokens, tries) of one request; an image that is too large is tried again smaller, an answer
    that is not sound is asked for once more."""
    if request is None:
        return None, 0, 0

    def call(r: Request) -> Answer:
        gate.wait()
        return answered(provider, r)

    def tried(r: Request) -> Answer:
        try:
            return retry(lambda: call(r)) or Answer(None)
        except Oversize:
            less = smaller(r.image) if smaller and r.image is not None else None
            if less is None:
                raise
            return retry(lambda: call(r.with_image(less))) or Answer(None)

    first = tried(request)
    if sound is None or first.text is None or sound(first.text):
        return first.text, first.tokens, 1
    again = tried(request)
    return again.text, first.tokens + again.tokens, 2


def ask(provider, make: Callable[..., Request | None], *columns: Column, pace: Pace | None = None, smaller: Callable | None = None, sound: Callable[[str], bool] | None = None) -> Column:
    """A struct of ANSWER for each row: what the provider says to make(*values of the columns).  No request,
    no call; a refusal gives no answer."""
    pace = pace or Pace()
    packed = cloudpickle.dumps((provider, make, smaller, sound))
    spark = SparkSession.getActiveSession()
    bounded(spark)
    places = spark.sparkContext.defaultParallelism if spark else 1
    gap = places / pace.per_second if pace.per_second else 0.0
    in_flight = pace.in_flight

    @F.pandas_udf(ANSWER)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        (client, request, less, fine), pool, gate = _client(packed, in_flight, gap)
        rows = (list(zip(*part)) for part in series(batches, in_flight))
        for found in in_order(pool, rows, lambda *row: one(client, request(*row), less, fine, gate)):
            yield pd.DataFrame(found, columns=["answer", "tokens", "tries"]).astype({"answer": object})

    return run.asNondeterministic()(*columns)


def with_answers(rows: DataFrame, asked: Column) -> DataFrame:
    """rows with the fields of ANSWER as _answer, _tokens, _tries."""
    held = rows.withColumn("_asked", asked)
    return held.select(*rows.columns, *[F.col(f"_asked.{c}").alias(f"_{c}") for c in ("answer", "tokens", "tries")])
