"""What both classifiers share: the labelled rows that may be learned from, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import row_count

#: Labelled documents that a classifier learns from at most, and the bytes of their texts together.  The
#: smallest hashes of doc_id are taken, so the same table always gives the same model.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 64 << 20


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0: rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most `most` rows that are not held out, by ascending doc_id; of these, in
    order of their hashes, so many that their texts are within `most_bytes`.  Both bounds make the list
    fit the driver.  A doc_id that is labelled both ways is left out; of repeated documents the smallest
    text counts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z")
    known = known.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("doc_id").alias("_h"), F.col("_y").cast("int").alias("_y"))
    n = row_count(known)
    if n > 2 * most:  # so that all tasks together send some 1.5 * most rows, not each of them `most`
        known = known.where(F.pmod("_h", F.lit(1 << 40)) < F.lit((1 << 40) * 3 * most // (2 * n)))
        order = [F.pmod("_h", F.lit(1 << 40)), "_d"]
    else:
        order = ["_h", "_d"]
    picked = [(r["_d"], r["_y"]) for r in known.orderBy(*order).limit(most).collect()]  # two numbers for each of at most `most` rows
    place = {d: i for i, (d, _) in enumerate(picked)}
    spark = docs.sparkSession

    def texts(rows):
        small = spark.createDataFrame(rows, "_d long, _y int")
        found = docs.select(F.col("doc_id").cast("long").alias("_d"), "text").join(F.broadcast(small), "_d")
        return found.groupBy("_d").agg(F.min("text").alias("text"), F.min("_y").alias("_y"))  # repeated rows count once

    sizes = {r["_d"]: r["n"] or 0 for r in texts(picked).select("_d", F.octet_length("text").alias("n")).collect()}
    held, total = [], 0
    for d in sorted(sizes, key=place.get):
        total += sizes[d]
        if held and total > most_bytes:
            break
        held.append(picked[place[d]])
    return sorted((r["_d"], r["text"] or "", r["_y"]) for r in texts(held).toLocalIterator())
