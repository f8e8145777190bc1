"""Pages that arrive over time: each micro-batch goes through the same stages and into the store.

Storing replaces what a page had before, so a batch that runs twice leaves one copy, and the models
are asked once for each node of a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern import schema
from quern.plans.ingest import initial_nodes, transformed
from quern.providers import Providers
from quern.sources.store import GraphStore, load_stage, remove, save_stage


def page_stream(spark, path: str) -> DataFrame:
    """Pages of the files that arrive, with `arrived`, their time."""
    return spark.readStream.schema(schema.PAGE_SCHEMA).parquet(path).select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def latest(batch: DataFrame) -> DataFrame:
    """One row for each page_id: the last to arrive; of those that came together the greatest content."""
    time = [F.col("arrived").desc_nulls_last()] if "arrived" in batch.columns else []
    order = Window.partitionBy("page_id").orderBy(*time, F.desc("content"), F.desc("title"), F.desc("html"))
    return batch.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place", "arrived")


def ingest_stream(pages: DataFrame, graph: GraphStore, checkpoint: str, providers: Providers | None = None, once: bool = False) -> StreamingQuery:
    """Store pages as they come.  The providers' counters, if they have some, are settled and logged after each
    batch; a counting.PageListener of the session gets how many pages there were, out of the stream itself."""
    providers = providers or Providers()

    def each(batch: DataFrame, _: int) -> None:
        place = f"{graph.config.path}/staged/{uuid.uuid4().hex}"

        def staged(rows: DataFrame, name: str) -> DataFrame:
            save_stage(rows, f"{place}/{name}")
            return load_stage(graph.spark, f"{place}/{name}")

        own = staged(latest(batch), "pages")  # what comes over a network, say, is read once
        if not own.isEmpty():
            rows = transformed(staged(initial_nodes(own, providers), "nodes"), providers).drop("last_transformed")
            graph.store(providers.counters.nodes(rows) if providers.counters else rows)
            if providers.counters:
                providers.counters.log()
        remove(graph.spark, place)

    pages = pages.observe("pages", F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
    writer = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
