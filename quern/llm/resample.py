"""Target-distribution importance resampling by hashed word runs (Xie et al., 2023).

Features are runs of one and two words, hashed into buckets; a bucket's gain is the logarithm, in
thousandths, of how much likelier it is in the target than in the documents, and a document's weight is
the mean gain of its features.  Adding Gumbel noise and taking the highest scores draws without
replacement in proportion to the weights.

1. A pass over documents and one over the target count the buckets: tasks send sums, never features.
2. The gains are one array; a second pass adds up each document's entries (array-scored weights).
3. Scores are whole numbers, so a histogram holds all there is to know of their order: its range is
   bounded (LEVELS), however many documents there are.  Counts summed from the highest score down say at which
   rank each score begins, and which score is the cutoff.
4. Only scores at or above the cutoff are ranked: row_number by doc_id within each score, plus the rank
   at which the score begins.  No sort of all documents, and nothing in one task.

Rows of one doc_id and equal figures are ranked as one with a multiplicity, so that a doc_id that is
repeated very often makes no task large.

Defined cases: a null text is an empty one, of weight 0; a row without a doc_id gets a weight, but no score
and no rank; repeated rows are drawn one by one, of equal score and doc_id the fewest features first; an
empty target leaves gains that depend on the documents alone; no documents give no rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import expanded, lean, materialise, slices, text_buffer, word_spans

#: No more different scores than this: counts below 2^63 keep gains within +-88,000, and the noise of a
#: 32-bit hash lies between -3,200 and 22,900.
LEVELS = 210_000
#: Words of more bytes are hashed one by one from there on.
LONG_WORD = 48

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def _table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_CRC = _table()
_FULL = np.uint32(0xFFFFFFFF)


def crc_on(register: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The crc32 registers after the bytes of each span, all spans a byte at a time together."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    out, at, left = register[order], start[order], size[order]
    for step in range(min(LONG_WORD, int(left[0]) if len(left) else 0)):
        n = int(np.searchsorted(-left, -step, "left"))
        out[:n] = _CRC[(out[:n] ^ data[at[:n] + step]) & np.uint32(255)] ^ (out[:n] >> np.uint32(8))
    for i in range(int(np.searchsorted(-left, -LONG_WORD, "left"))):
        rest = data[at[i] + LONG_WORD : at[i] + left[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def buckets_of(data: np.ndarray, off: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of the run that each word begins, first word of each document); a
    document's last word begins no run: -1."""
    data = _FOLD[data]
    start, end, first = word_spans(_INSIDE[data], off)
    one = crc_on(np.full(len(start), _FULL), data, start, end)
    word = ((one ^ _FULL) % np.uint32(buckets)).astype(np.int64)
    run = np.full(len(start), -1, np.int64)
    begins = np.ones(len(start), bool)
    begins[first[1:][first[1:] > 0] - 1] = False
    i = np.flatnonzero(begins)
    space = _CRC[(one[i] ^ np.uint32(32)) & np.uint32(255)] ^ (one[i] >> np.uint32(8))
    run[i] = (crc_on(space, data, start[i + 1], end[i + 1]) ^ _FULL) % np.uint32(buckets)
    return word, run, first


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts (column `text`); `buckets` numbers reach the driver."""

    def run(batches):
        count = np.zeros(buckets, np.int64)
        for b in slices(batches, "text"):
            word, pair, _ = buckets_of(*text_buffer(b.column(0)), buckets)
            count += np.bincount(word, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[r[0]] = r[1]
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, one added to each bucket."""
    s, t = float(have.sum() + len(have)), float(want.sum() + len(want))
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(have.tolist(), want.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features."""

    def sums(values, first):
        total = np.concatenate([[0], np.cumsum(values)])
        return total[first[1:]] - total[first[:-1]]

    def run(batches):
        for b in slices(batches, "text"):
            word, pair, first = buckets_of(*text_buffer(b.column(1)), len(gain))
            n = np.diff(first)
            total = sums(gain[word], first) + sums(np.where(pair >= 0, gain[pair], 0), first)
            features = n + np.maximum(n - 1, 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(features), pa.array(total // np.maximum(features, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int):
    """floor(1000 times Gumbel noise) of the first 32 bits of sha256 of `seed:doc_id`; null without one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, least_words: int = 20, buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn.

    Of the N documents with `least_words` words or more, floor(percent * N / 100) are drawn."""
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = materialise(weights(docs, gain).select("*", (F.col("weight") + noise(seed)).alias("score")), "resample-scores")
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    levels = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("score")).collect()  # LEVELS rows at most
    score, n = (np.array([r[i] for r in levels], np.int64) for i in (0, 1))
    before = np.cumsum(n) - n
    quota = percent * int(n.sum()) // 100
    own = before < quota
    columns = ["doc_id", "n_features", "weight", "score"]
    if not own.any():
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    cutoff = int(score[own][-1])
    offsets = spark.createDataFrame(list(zip(score[own].tolist(), before[own].tolist())), "score long, begins long")
    top = able & (F.col("score") >= cutoff)
    rest = scored.where(~F.coalesce(top, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank"))
    alike = scored.where(top).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    within = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("earlier", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(offsets), "score")
    each = expanded(placed, "copies", "copy").withColumn("rank", F.col("begins") + F.col("earlier") + F.col("copy") + 1)
    return rest.unionByName(each.select(*columns, F.when(F.col("rank") <= quota, F.col("rank")).alias("rank")))
