"""What a Python function holds at a time is bounded by bytes, whatever the batches that come."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import batches
from quern.operators import asking, chunking
from quern.providers import RuleText
from quern.sources import text_index


def test_cuts_cover_all_rows_once():
    rng = np.random.default_rng(1)
    for least in (1, 5):
        sizes = rng.integers(0, 50, 200).tolist() + [1000, 3, 0]
        got = list(batches.cuts(sizes, least, 100))
        assert [a for a, _ in got] == [0, *[z for _, z in got[:-1]]] and got[-1][1] == len(sizes)
        assert all(z - a >= least for a, z in got[:-1])
        assert all(sum(sizes[a:z]) <= 100 or z - a <= least for a, z in got)
    assert list(batches.cuts([])) == []


def test_postings_of_a_large_batch_come_in_parts():
    texts = [None, "", *[" ".join(f"w{i}x{j}" for j in range(1500)) for i in range(300)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    got = list(text_index.counted([batch]))
    assert max(b.num_rows for b in got) < 60_000 < sum(b.num_rows for b in got)
    assert sum(b.num_rows for b in got) == len(texts) + 300 * 1500
    assert [i for b in got for i, t in zip(b["id"].to_pylist(), b["term"].to_pylist()) if t == ""] == list(range(len(texts)))


def test_columns_come_in_parts_with_enough_rows_for_all_calls():
    columns = (pd.Series(["x" * 100_000] * 100), pd.Series(range(100)))
    got = list(batches.series([columns], 32))
    assert [len(p[0]) for p in got] == [32, 32, 32, 4] and [i for p in got for i in p[1]] == list(range(100))


def test_rows_of_whole_texts_come_in_smaller_arrow_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for run in (lambda df: chunking.chunk_rows(df, ["id"], "text"), lambda df: df.select(asking.ask(RuleText(), lambda t: None, F.col("text")))):
            spark.conf.set(key, "10000")
            df = spark.range(5000).repartition(1).select("id", F.lit("One. Two.").alias("text"))
            assert run(df).count() >= 5000
            assert spark.conf.get(key) == str(batches.ROWS)
            spark.conf.set(key, "77")
            run(df)
            assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)
