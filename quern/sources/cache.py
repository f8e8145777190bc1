"""Derived nodes that are kept page by page, and know what they were derived from.

A page's fingerprint covers all it holds and all that derives from it: the models with their settings, what
they are asked, and the name of the stage.  A run derives the pages of which no fingerprint is in the
manifest, appends their nodes, then their fingerprints; so a run that breaks off is not believed, and one
changed page costs one page.  Runs at the same time may derive a page twice; the rows of one of them count."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, is_dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.providers import FUNCTIONS, INSTRUCTIONS, Providers
from quern.sources.commits import names


def described(model) -> dict:
    """A provider's class and settings, as far as they are plain values."""
    if model is None:
        return {}
    own = asdict(model) if is_dataclass(model) else dict(vars(model)) if hasattr(model, "__dict__") else {}
    plain = {k: v for k, v in own.items() if k != "key" and isinstance(v, (str, int, float, bool, type(None), tuple, list))}
    return {"class": f"{type(model).__module__}.{type(model).__qualname__}", **plain}


def models_print(providers: Providers, *more) -> str:
    """What nodes depend on besides their page."""
    made = [described(m) for m in (providers.embedding, providers.text, providers.vision, providers.images)]
    return hashlib.sha256(json.dumps([made, INSTRUCTIONS, FUNCTIONS, *map(str, more)], sort_keys=True, default=str).encode()).hexdigest()


def page_print(pages: DataFrame, models: str) -> Column:
    """sha256 of every column of a page, nulls apart from what is empty, and of `models`."""
    parts = [F.coalesce(F.sha2(F.to_json(F.struct(F.col(c))).cast("binary"), 256), F.lit("-")) for c in sorted(pages.columns)]
    return F.sha2(F.concat_ws("|", F.lit(models), *parts), 256)


class PageCache:
    """`rows/batch=...` and `manifest/batch=...` under a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _manifest(self) -> DataFrame:
        schema = "page_id string, fingerprint string, batch string"
        if not names(self.spark, f"{self.path}/manifest"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifest").groupBy("page_id", "fingerprint").agg(F.min("batch").alias("batch"))

    def nodes(self, pages: DataFrame, derive: Callable[[DataFrame], DataFrame], models: str) -> DataFrame:
        """derive(pages) by page_id: from what is kept where it fits, derived and kept otherwise.  derive's rows carry
        page_id; a page without nodes is remembered too."""
        wanted = pages.withColumn("fingerprint", page_print(pages, models))
        new = wanted.join(self._manifest().select("page_id", "fingerprint"), ["page_id", "fingerprint"], "left_anti")
        if not new.isEmpty():
            batch = uuid.uuid4().hex
            made = derive(new.select(*pages.columns))
            made.write.parquet(f"{self.path}/rows/batch={batch}")
            new.select("page_id", "fingerprint").distinct().write.parquet(f"{self.path}/manifest/batch={batch}")
        have = wanted.select("page_id", "fingerprint").distinct().join(self._manifest(), ["page_id", "fingerprint"])
        if not names(self.spark, f"{self.path}/rows"):
            return derive(pages.limit(0))
        rows = self.spark.read.schema(self._schema()).option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return rows.join(have.select("page_id", "batch"), ["page_id", "batch"], "left_semi").drop("batch")

    def _schema(self) -> T.StructType:
        one = names(self.spark, f"{self.path}/rows")[0]
        own = self.spark.read.parquet(f"{self.path}/rows/{one}").schema
        return own.add("batch", "string")

    def forget(self, pages: DataFrame, models: str) -> int:
        """Remove batches of which no page stands as it is here; returns how many."""
        from quern.sources.store import remove

        wanted = pages.withColumn("fingerprint", page_print(pages, models)).select("page_id", "fingerprint")
        used = {r[0] for r in wanted.join(self._manifest(), ["page_id", "fingerprint"]).select("batch").distinct().collect()}  # a name for each run that derived something
        gone = [n for n in names(self.spark, f"{self.path}/manifest") if n.startswith("batch=") and n.removeprefix("batch=") not in used]
        for n in gone:
            remove(self.spark, f"{self.path}/manifest/{n}")
            remove(self.spark, f"{self.path}/rows/{n}")
        return len(gone)
