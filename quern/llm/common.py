"""Shared plumbing: the shared folder, materialised tables, Arrow text buffers, mixing."""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
ARROW_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent and all run on one machine (tests, a laptop) is a folder of our
    own set; a cluster without it is an error, as each executor would write to its own disk."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
            atexit.register(_remove, spark, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is already gone: nothing is left to ask
        return


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place for an intermediate table in the shared folder; removed at exit."""
    uri = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, uri)
    return uri


@contextmanager
def few_files(spark: SparkSession):
    """Small tables in few files: shuffles inside are brought together to the advisory partition size, and
    not cut again to occupy every core."""
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage, survives executors."""
    spark = df.sparkSession
    uri = new_path(spark, name)
    schema = df.schema
    with few_files(spark):
        df.write.parquet(uri)
    return spark.read.schema(schema).parquet(uri)


def discard(df: DataFrame) -> None:
    """Delete an intermediate table that no later plan reads."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()[:1]}:
        _remove(df.sparkSession, f)


class Scratch:
    """Intermediate tables of one operator, deleted together once its result is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(materialise(df, name))
        return self.tables[-1]

    def own(self, table: DataFrame) -> DataFrame:
        """An intermediate table that was written elsewhere, to be deleted with the others."""
        self.tables.append(table)
        return table

    def result(self, df: DataFrame, name: str) -> DataFrame:
        done = materialise(df, name)
        for t in self.tables:
            discard(t)
        self.tables.clear()
        return done


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy per row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(off):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[off[0] : off[-1]] if bufs[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each is about `most` bytes; one long row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply) on uint64 values."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: LOW[n]: the first n bytes of a little-endian word.
LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_SEED, _TURN = U64(0xD6E8FEB86659FD93), U64(0x9E3779B97F4A7C15)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer on as one number (zeros after the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: depends on the bytes and their number only.

    Eight bytes at a time are mixed in, for all spans at once; every step is nonlinear, so no two
    texts of a simple make hash alike.  What is left of a long span goes through BLAKE2."""
    word = words_at(data)
    left = end - start
    out = left.astype(U64) * _SEED
    live, at = None, start
    for step in range(0, LONG_SPAN, 8):
        part = word[at] & LOW[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ part)
        else:
            out[live] = mix(out[live] * _TURN ^ part)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i, a, n in zip(live.tolist(), at.tolist(), left.tolist()):
        rest = hashlib.blake2b(data[a : a + n].tobytes(), digest_size=8).digest()
        out[i] ^= U64(int.from_bytes(rest, "little"))
    return out


_kept: dict = {}


def kept(key: tuple, make: Callable):
    """What make() gives, once for the tasks of a worker that name the key (see lean)."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(uses: tuple = ()) -> None:
    for key in [k for k in _kept if k not in uses]:
        del _kept[key]


def lean(run: Callable, uses: tuple = ()) -> Callable:
    """run, a function of record batches, giving its memory back to the system when it ends: a worker
    is used again, and would keep the most that any of its tasks had.  What earlier tasks have kept()
    goes, but for the keys it uses.  Where the session has Spark's default of 10,000 rows to an Arrow batch
    it gets ARROW_ROWS, as rows hold whole texts."""
    spark = SparkSession.getActiveSession()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ARROW_ROWS))

    def held(batches):
        forget(uses)
        try:
            yield from run(batches)
        finally:
            trim()

    return held


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then from first[1] on, and so on."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)


def digest(data) -> str:
    return hashlib.sha256(data).hexdigest()


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def word_spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words of a buffer: maximal runs of `inside` that stay in one
    document; first[i] is the index of document i's first word."""
    begin, stop = inside.copy(), inside.copy()
    if len(inside):
        begin[1:] &= ~inside[:-1]
        firsts = off[:-1][np.diff(off) > 0]
        begin[firsts] = inside[firsts]
        stop[:-1] &= ~inside[1:] | begin[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, off)


#: Rows that one array makes in expanded(), at most.
COPIES = 4096


def expanded(df: DataFrame, count: str, name: str) -> DataFrame:
    """Each row as often as `count` says, with a number from 0 on as `name`; in two steps, so that no array is
    long."""
    part, n = fresh(df, "part"), F.col(count)
    wide = df.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES).cast("long"))))
    last = F.least(n - F.col(part) * COPIES, F.lit(COPIES)) - 1
    wide = wide.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return wide.withColumn(name, F.col(name) + F.col(part) * COPIES).drop(part)
