"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

File layout (little-endian):

* data frames: each an independent zstandard frame over the ids (unsigned 32-bit) of whole
  documents, about `frame_bytes` of ids each; a longer document is a frame of its own;
* one index frame: zstandard over int64 doc_id[n], int64 n_tokens[n], int64 frame[n];
* a skippable frame (magic 0x184D2A5E) that holds the seek table: for each frame before it
  (compressed size, decompressed size, low 32 bits of XXH64 of the decompressed bytes) as
  unsigned 32-bit integers, then the number of frames, a descriptor byte (0x80: checksums are
  there) and the magic 0x8F92EAB1.

Any zstandard decoder reads the file as one stream; a reader with the seek table decompresses
only the frames of the documents it asks for, and checks each by its own checksum.

Defined cases: null text counts as empty (the end id alone); a null doc_id sorts first;
equal doc_ids stay apart, ordered by the crc32 of their ids; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import kept, lean, materialise, new_path, ranges, row_count, slices, text_buffer
from quern.llm.memo import PieceMemo

SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 20
#: Bytes of input to a file; rows, about, that are drawn for the cuts (or 64 a file); what a plan's estimate says that knows nothing.
FILE_BYTES, CUT_SAMPLE, UNKNOWN_BYTES = 256 << 20, 20_000, 1 << 60
#: What stands for no doc_id in the files.
NO_ID = int(np.iinfo(np.int64).min)
#: What bytes are to the byte-level pattern: letters, digits, other marks, apostrophe, space, line ends and
#: tabs; 0 for all that can't be told from one byte.
_LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _BLANK = range(1, 7)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x80] = _KIND[0:9] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27], _KIND[0x20] = _QUOTE, _SPACE
_KIND[9:14] = _BLANK
#: Whether a pre-token surely begins between two such bytes.
_CUT = np.zeros((7, 7), bool)
_CUT[1:5, 1:7] = _CUT[6, 1:5] = True
_CUT[range(1, 7), range(1, 7)] = _CUT[_MARK, _QUOTE] = _CUT[_QUOTE, _MARK] = _CUT[_QUOTE, _LETTER] = False


_LINE = re.compile(r" ?\S(?:[^\n]*\S)?")


def boundaries(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places in the texts of a buffer before which a new pre-token surely begins."""
    kind = _KIND[data]
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # the letters from U+00C0 to U+00FF
    kind[two] = kind[two + 1] = _LETTER
    cut = np.zeros(len(data), bool)
    cut[1:] = _CUT.ravel()[kind[:-1] * np.uint8(7) + kind[1:]]
    solid = (kind > 0) & (kind < _SPACE)
    led = (kind[:-1] >= _SPACE) & solid[1:]  # of white space the last character stands apart: a space with what follows
    end = off[1:] - 1
    led[end[(end >= 0) & (end < len(led))]] = False  # in its own text, that is
    cut[:-1] |= led
    return cut


class Encoder:
    """The tokenizers library behind a memo of pieces.

    Texts are cut where a new pre-token of the byte-level pattern surely begins, so each piece may be
    encoded by itself, and each distinct one is by the library just once while the memo holds it.  A
    text that holds one of the library's special tokens is one piece."""

    def __init__(self, path: str, keep: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = kind_of(self.tokenizer)
        self.memo = PieceMemo(self._library, self.kind, keep)
        self.line_end = self._encode("\n")

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _library(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each piece).  Pieces that begin (after a space at most) and end without white
        space are put on lines of one text: a line end there is a token of its own, and tells where the
        next piece begins."""
        texts = [p.decode("utf-8") for p in pieces]
        off, size, pool, base = np.zeros(len(texts), np.int64), np.full(len(texts), -1), [], 0
        lines = [i for i, t in enumerate(texts) if _LINE.fullmatch(t)] if len(self.line_end) == 1 else []
        for at in range(0, len(lines), 5000):
            some = lines[at : at + 5000]
            text = "\n".join([texts[i] for i in some])
            if any(s in text for s in self.special):
                continue
            ids = np.array(self._encode(text), self.kind)
            ends = np.append(np.flatnonzero(ids == self.line_end[0]), len(ids))
            if len(ends) == len(some):
                begin = np.append(0, ends[:-1] + 1)
                off[some], size[some] = base + begin, ends - begin
                pool.append(ids)
                base += len(ids)
        for i in np.flatnonzero(size < 0).tolist():
            pool.append(np.array(self._encode(texts[i]), self.kind))
            off[i], size[i] = base, len(pool[-1])
            base += len(pool[-1])
        return np.concatenate(pool)[ranges(off, size)], size

    def buffer(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a buffer one after another, how many each has)."""
        cut = np.append(boundaries(data, off), False)
        raw, special = data.tobytes(), [s.encode() for s in self.special]
        if any(s in raw for s in special):
            for a, z in zip(off[:-1].tolist(), off[1:].tolist()):
                if any(s in raw[a:z] for s in special):
                    cut[a:z] = False
        cut[off] = True
        cut[len(data)] = False
        start = np.flatnonzero(cut)
        ids, count = self.memo.ids(data, start, np.append(start[1:], len(data)) if len(start) else start)
        before = np.concatenate([[0], np.cumsum(count)])
        edge = before[np.searchsorted(start, off)]
        return ids, np.diff(edge)

    def ended(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """buffer(), with an id after each text."""
        ids, count = self.buffer(data, off)
        count = count + 1
        last = np.zeros(len(ids) + len(count), bool)
        last[np.cumsum(count) - 1] = True
        out = np.full(len(last), end_id, self.kind if end_id <= np.iinfo(self.kind).max else np.uint32)
        out[~last] = ids
        return out, count

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.buffer(data, np.array([0, len(data)]))[0].astype("<u4").tobytes()


def encoder(path: str) -> Encoder:
    """The encoder that the tasks of a worker share, if they are lean(..., (("encoder", path),))."""
    return kept(("encoder", path), lambda: Encoder(path))


def kind_of(tokenizer) -> type:
    """Two bytes an id where these do."""
    return np.uint16 if tokenizer.get_vocab_size() <= 65536 else np.uint32


def packed_rows(ids: np.ndarray, count: np.ndarray) -> pa.Array:
    """A binary array with the ids of each text, without a copy."""
    ends = np.concatenate([[0], np.cumsum(count)]) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


# ---------------------------------------------------------------- the file format


def write_file(out, docs: Iterator[tuple[int | None, bytes]], frame_bytes: int = FRAME_BYTES, level: int = 1) -> tuple[int, int]:
    """Write (doc_id, packed ids) in the order given; returns (documents, ids)."""
    pack = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
    table: list[tuple[int, int, int]] = []
    index: list[tuple[int, int, int]] = []
    held: list[bytes] = []
    size = total = 0

    def frame(raw: bytes) -> None:
        small = pack.compress(raw)
        out.write(small)
        table.append((len(small), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    for doc_id, ids in docs:
        if held and size + len(ids) > frame_bytes:
            frame(b"".join(held))
            held, size = [], 0
        index.append((NO_ID if doc_id is None else doc_id, len(ids) // 4, len(table)))
        held.append(ids)
        size += len(ids)
        total += len(ids) // 4
    if held:
        frame(b"".join(held))
    frame(np.array(index, "<i8").reshape(-1, 3).T.tobytes())
    seek = b"".join(struct.pack("<III", *t) for t in table) + struct.pack("<IBI", len(table), CHECKSUMS, SEEKABLE)
    out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
    return len(index), total


class TokenFile:
    """Random access to a token file through any seekable binary file object."""

    def __init__(self, f):
        self.f = f
        f.seek(0, 2)
        end = f.tell()
        f.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE or not descriptor & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        f.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()
        self.doc_id, self.n_tokens, self.frame_of = np.frombuffer(self.frame(n - 1), "<i8").reshape(3, -1)
        self.reads = 0

    def frame(self, k: int) -> bytes:
        small, size, check = map(int, self.table[k])
        self.f.seek(int(self.at[k]))
        raw = self.unpack.decompress(self.f.read(small), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k}: its checksum does not fit")
        self.reads = getattr(self, "reads", 0) + 1
        return raw

    def document(self, row: int) -> np.ndarray:
        """The ids of one document; decompresses its frame only."""
        k = self.frame_of[row]
        first = int(np.searchsorted(self.frame_of, k))
        at = int(self.n_tokens[first:row].sum())
        return np.frombuffer(self.frame(int(k)), "<u4")[at : at + int(self.n_tokens[row])]

    def documents(self) -> Iterator[tuple[int, bytes]]:
        k, raw, at = -1, b"", 0
        for doc_id, n, of in zip(self.doc_id.tolist(), self.n_tokens.tolist(), self.frame_of.tolist(), strict=True):
            if of != k:
                k, raw, at = of, self.frame(of), 0
            yield doc_id, raw[at : at + 4 * n]
            at += 4 * n


# ---------------------------------------------------------------- the operator


def _open(uri: str, mode: str):
    """A file of the shared folder, through pyarrow's file systems (local, HDFS, object stores)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system, path, system.open_input_file(path)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system, path, system.open_output_stream(path, compression=None)


def file_cuts(keys: DataFrame, files: int) -> np.ndarray:
    """files - 1 doc_ids (column `doc_id`, whole numbers) that cut the rows about evenly, from a sample of
    CUT_SAMPLE rows or so.  They balance the files, no more: any cuts give the same order."""
    n = row_count(keys) if files > 1 else 0
    if not n:
        return np.zeros(0, np.int64)
    share = min(1.0, max(64 * files, CUT_SAMPLE) / n)
    drawn = keys if share == 1 else keys.sample(share, seed=3)
    found = np.sort(np.array([r[0] for r in drawn.collect()], np.int64))
    return found[np.arange(1, files) * len(found) // files] if len(found) else np.zeros(0, np.int64)


def file_count(docs: DataFrame) -> int:
    """A file for each FILE_BYTES of what docs is read from, by the plan's own estimate where it has
    one, and no fewer than a shuffle has partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // FILE_BYTES)) if size < UNKNOWN_BYTES else least


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, uri: str | None = None, files: int | None = None) -> DataFrame:
    """Write all documents, ascending by doc_id, as token files; returns the manifest.

    Texts are encoded once, where they are read; only packed ids are shuffled, to ranges of doc_id
    (file_cuts).  doc_ids are whole numbers all along, so that those above 2^53 keep their order.  Where
    several cuts fall on one doc_id, its rows are dealt over the files between by the crc32 of their
    ids, which is their order.
    A task writes each file under a name of its own attempt and renames it when complete, so a
    task that runs twice leaves one whole file.  The manifest has a row for each file:
    (file, uri, n_docs, n_ids, start), start being the ids in all earlier files."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    uri = uri or new_path(spark, "tokens")
    n = files or file_count(docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = file_cuts(ids.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")), n)
    kind = np.dtype(np.uint32 if end_id > 65535 else kind_of(Tokenizer.from_file(path)))

    def encode(batches):
        enc = encoder(path)
        for b in slices(batches, "text", 1 << 20):
            made, count = enc.ended(*text_buffer(b.column(1)), end_id)
            made = made.astype(kind, copy=False)
            rows = packed_rows(made, count)
            key = b.column(0).fill_null(NO_ID).to_numpy()
            first, last = np.searchsorted(cuts, key, "left"), np.searchsorted(cuts, key, "right")
            for i in np.flatnonzero(last > first + 1).tolist():  # an id that fills files by itself: by the crc32 of its ids
                last[i] = first[i] + (zlib.crc32(rows[i].as_buffer()) * int(last[i] - first[i] + 1) >> 32)
            yield pa.RecordBatch.from_arrays([pa.array(last, pa.int32()), b.column(0), rows], names=["file", "doc_id", "ids"])

    ids = ids.mapInArrow(lean(encode, (("encoder", path),)), "file int, doc_id long, ids binary")
    ids = ids.repartitionById(n, "file").sortWithinPartitions("file", "doc_id", F.crc32("ids"))

    def run(batches):
        from itertools import groupby

        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for part, own in groupby(rows, lambda r: r[0]):
            name = f"{uri}/part-{part:06d}.tok"
            system, temp, out = _open(f"{name}.{attempt}.tmp", "w")
            with out:
                count, total = write_file(out, ((d, np.frombuffer(x, kind).astype("<u4").tobytes()) for _, d, x in own))
            system.move(temp, temp.rsplit(".", 2)[0])
            yield pa.RecordBatch.from_pydict({"file": [part], "uri": [name], "n_docs": [count], "n_ids": [total]})

    manifest = materialise(ids.mapInArrow(lean(run), "file long, uri string, n_docs long, n_ids long"), "tokens-manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest."""
    files = manifest.select("uri", "start")
    files = files.repartition(max(2, manifest.sparkSession.sparkContext.defaultParallelism * 2), "uri")

    def run(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, _, f = _open(uri, "r")
                with f:
                    held = TokenFile(f)
                    crc = [zlib.crc32(ids) for _, ids in held.documents()]
                    n = held.n_tokens.astype(np.int64)
                    doc_id = pa.array(held.doc_id.astype(np.int64), mask=held.doc_id == NO_ID)
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    return read_token_files(write_token_files(docs, path, end_id))
