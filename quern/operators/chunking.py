"""Semantic chunking: cut a text where neighbouring sentences differ most.

Sentences are compared with their neighbours around them (buffer 1): the vector is of previous,
own and next sentence together; a cut follows a sentence whose distance to the next exceeds the
text's 70th percentile of distances.  A text is worked off where it lies, in one Arrow function, so no
row is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.batches import bounded, series

#: Fixed value: a sentence with its end marks and the white space (ASCII) after it.
SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*", re.ASCII)


def letter_counts(texts: list[str]) -> np.ndarray:
    """A small deterministic vector: how often each letter occurs."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    row = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    at = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) - ord("a")
    own = (at >= 0) & (at < 26)
    return np.bincount(row[own] * 26 + at[own], minlength=26 * len(raw)).reshape(len(raw), 26).astype(np.float64)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def percentile(values: np.ndarray, p: float) -> float:
    """With linear interpolation between the two nearest."""
    ordered, at = np.sort(values), p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return ordered[low] if low == high else (high - at) * ordered[low] + (at - low) * ordered[high]


def chunks_of(text: str | None, vector: Callable[[list[str]], np.ndarray] = letter_counts, buffer: int = 1, p: float = 0.7) -> list[str]:
    """The chunks of a text, in order; none without sentences."""
    found = SENTENCE.findall(text or "")
    if len(found) < 2:
        return found
    around = ["".join(found[max(0, i - buffer) : i + buffer + 1]) for i in range(len(found))]
    e = np.asarray(vector(around), np.float64)
    norm = np.sqrt((e * e).sum(1))
    both = norm[:-1] * norm[1:]
    cosine = np.divide((e[:-1] * e[1:]).sum(1), both, out=np.zeros(len(both)), where=both > 0)
    distance = np.round(1.0 - cosine, 9)
    cuts = np.flatnonzero(distance > np.round(percentile(distance, p), 9)) + 1
    return ["".join(found[a:z]) for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(found)])]


def chunk_rows(df: DataFrame, keys: list[str], text: str, vector: Callable[[list[str]], np.ndarray] = letter_counts, buffer: int = 1, p: float = 0.7) -> DataFrame:
    """(keys..., chunk_no, chunk): the chunks of each row's text, in order; none of a text without
    sentences, or of null.  `vector` maps texts to rows of numbers."""
    bounded(df.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for (texts,) in series((b,) for b in batches):
            yield texts.map(lambda t: chunks_of(t, vector, buffer, p))

    return df.select(*keys, F.posexplode(cut(F.col(text))).alias("chunk_no", "chunk"))
