"""Counts of a run while it runs: what stages ask models, what nodes they make, out of the one pass over the data.

Each is an observation of Spark: aggregates that are taken along where rows pass by, exact however often a
task is tried.  They are known as soon as the action that evaluates the rows has ended; nothing is read again."""

from __future__ import annotations

import logging
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quern import schema
from quern.functions import text

#: Types of nodes that are counted one by one; all others are counted together.
TYPES = ("page", "section", "subsection", "table", "image", "plot", "citation", "archive-citation", "wiki-ref", "table_analysis", *schema.DERIVED)


def observed(seen: Observation, patience: float = 5.0) -> dict[str, int]:
    """What an observation has counted; nothing where the optimiser had left it out, as over no rows at all.
    Its counts come over a moment after the action has ended."""
    until = time.monotonic() + patience
    while not seen._jo.future().isCompleted():
        if time.monotonic() > until:
            return {}
        time.sleep(0.02)
    return seen.get


class Counters:
    """Observations by name; several of one name (a stage that runs in each batch) add up."""

    def __init__(self, token_price: float = 0.00002):
        self.token_price = token_price
        self.open: list[tuple[str, Observation]] = []
        self.known: dict[str, dict[str, int]] = {}

    def _watch(self, rows: DataFrame, name: str, **counts) -> DataFrame:
        seen = Observation()
        self.open.append((name, seen))
        return rows.observe(seen, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()])

    def asked(self, rows: DataFrame, stage: str, image: bool = False) -> DataFrame:
        """rows of asking.with_answers, counted as they pass."""
        was = F.col("_tries") > 0
        usable = F.coalesce(text.usable_answer(F.col("_answer"), image), F.lit(False))
        return self._watch(rows, stage, asked=F.count_if(was), again=F.count_if(F.col("_tries") > 1), refused=F.count_if(was & F.col("_answer").isNull()), unusable=F.count_if(was & F.col("_answer").isNotNull() & ~usable), tokens=F.sum("_tokens"))

    def nodes(self, rows: DataFrame) -> DataFrame:
        """Nodes by type."""
        each = {t.replace("-", "_"): F.count_if(F.col("type") == t) for t in TYPES}
        return self._watch(rows, "nodes", all=F.count(F.lit(1)), **each, other=F.count_if(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False))))

    def settle(self) -> dict[str, dict[str, int]]:
        """All counts so far, by stage.  To be called once the action that evaluates the rows has ended."""
        for name, seen in self.open:
            mine = self.known.setdefault(name, {})
            for k, v in observed(seen).items():
                mine[k] = mine.get(k, 0) + v
        self.open.clear()
        return self.known

    def tokens(self) -> int:
        return sum(c.get("tokens", 0) for c in self.settle().values())

    def cost(self) -> float:
        return self.tokens() * self.token_price

    def log(self) -> None:
        for name, counts in self.settle().items():
            logging.getLogger("quern").info("%s: %s", name, ", ".join(f"{v} {k}" for k, v in counts.items() if v))
        logging.getLogger("quern").info("%d tokens, %.4f", self.tokens(), self.cost())


class PageListener(StreamingQueryListener):
    """Pages and bytes of content that a stream has taken in, from what its progress says of the
    observation `pages` (see ingest_stream), and how many batches that were."""

    def __init__(self):
        self.pages = self.bytes = self.batches = 0
        self.failed: str | None = None

    def onQueryStarted(self, event) -> None:
        return

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("pages")
        if seen is not None and seen["pages"]:
            self.pages += seen["pages"]
            self.bytes += seen["bytes"]
            self.batches += 1

    def onQueryIdle(self, event) -> None:
        return

    def onQueryTerminated(self, event) -> None:
        self.failed = event.exception
