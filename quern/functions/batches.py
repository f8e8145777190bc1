"""Arrow batches in parts, bounded by the bytes of their texts.

A worker is used for many tasks and keeps the most that any of them took, so what a Python function holds
at a time must not grow with the rows of its partition."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that a Python function works on at a time, about; rows of an Arrow batch where the session has
#: Spark's default of 10,000.
PART, ROWS = 1 << 18, 2000


def bounded(spark: SparkSession | None) -> None:
    """ROWS to an Arrow batch from now on, unless the session has a number of its own: rows hold whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS))


def cuts(sizes: Sequence[int], least: int = 1, most: int = PART) -> Iterator[tuple[int, int]]:
    """(begin, end) of parts of about `most` bytes, of `least` rows at least; one long row stays whole."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i - begin >= least and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Record batches in parts by the bytes of one column."""
    try:
        for b in batches:
            for begin, end in cuts(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
                yield b.slice(begin, end - begin)
    finally:
        give_back()


def series(batches: Iterator[tuple[pd.Series, ...]], least: int = 1) -> Iterator[tuple[pd.Series, ...]]:
    """Columns in parts by the bytes of their texts and images."""
    try:
        for columns in batches:
            sizes = [sum(len(x) for x in row if isinstance(x, (str, bytes))) for row in zip(*columns)]
            for begin, end in cuts(sizes, least):
                yield tuple(c.iloc[begin:end] for c in columns)
    finally:
        give_back()


def give_back() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return
