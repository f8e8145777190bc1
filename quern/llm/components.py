"""Connected components of an edge table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), as a written table: root is the smallest node it can
    reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge set stays
    the same; each step is a grouped minimum and a join back, so a node with very many links is
    aggregated map-side and its join is split like any skewed join.  Each step's table is written
    in the shared folder.  No edges give no rows."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "cc")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a != b").distinct()
        after = materialise(small, "cc")
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if found == state:
            break
        state = found
    labels = materialise(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "cc-labels")
    discard(now)
    return labels
