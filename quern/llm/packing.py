"""Variable-capacity best-fit packing.

Several sequence lengths are permitted; each has a cost.  Pieces are taken from the longest to the
shortest.  A piece goes into the open bin with the least room that holds it.  Where none does, a bin
is opened at the permitted length of least cost for each token it can expect to hold: the piece,
and as much of the room besides as the pieces still to come, of those short enough, and not already
spoken for by the room of other bins, can fill.  At the end each bin is downsized to the least
permitted length that holds its contents.

A document longer than the greatest length is cut into full sequences and a remainder; each full
sequence is a bin of its own, the remainder is packed like any piece.  Documents are dealt by hash
into groups, packed apart: the loss at group ends is some bins in thousands, and no task ever holds
more than a group.  The hash is of doc_id, tokens and the how-manieth such row of its task it is,
so rows that repeat, or have no doc_id, are spread like all others.

Defined cases: null and empty texts are their end id alone; a null or negative length counts as 0; a
length of 0 gives one row in no bin (bin and capacity null); repeated rows are packed each; equal
lengths go by doc_id; an empty table gives no rows; no column but doc_id and text is read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import lean, row_count, slices, text_buffer

CAPACITIES = (1024, 2048, 4096, 8192)
#: Documents, and tokens, of a group on average.
GROUP_ROWS, GROUP_TOKENS = 20_000, 8 << 20


def sequence_cost(capacity: int) -> float:
    """Linear work plus attention, which is quadratic."""
    return capacity * (1 + capacity / 32768)


def best_fit(lengths: list[int], capacities=CAPACITIES, cost=sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, offset of each piece, capacity of each bin); lengths must descend and
    fit the greatest capacity."""
    capacities = sorted(capacities)
    costs = [cost(c) for c in capacities]
    n = len(lengths)
    climbing = lengths[::-1]
    mass = [0]
    for x in climbing:  # mass[j]: the j shortest pieces together
        mass.append(mass[-1] + x)
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: a bin with room r is open
    spoken = 0  # room of all open bins
    used: list[int] = []
    size: list[int] = []
    bins, offsets = [0] * n, [0] * n
    for i, x in enumerate(lengths):
        fits = rooms >> x
        if fits:
            room = x + ((fits & -fits).bit_length() - 1)
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            spoken -= room
        else:
            best = None
            for c, price in zip(capacities[bisect_left(capacities, x) :], costs[bisect_left(capacities, x) :]):
                to_come = mass[min(n - i - 1, bisect_left(climbing, c - x + 1))]
                hold = x + min(c - x, max(0, to_come - spoken))
                if best is None or price / hold < best[0]:
                    best = (price / hold, c)
            b, room = len(used), best[1]
            used.append(0), size.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += x
        room -= x
        spoken += room
        by_room.setdefault(room, []).append(b)
        rooms |= 1 << room
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


@dataclass
class Layout:
    """Pieces of documents: whose, which in its document, where it begins there, how long, in which bin
    of what size, and where there."""

    who: np.ndarray
    piece: np.ndarray
    start: np.ndarray
    length: np.ndarray
    bin: np.ndarray
    capacity: np.ndarray
    offset: np.ndarray


def layout(n: np.ndarray, capacities=CAPACITIES) -> Layout:
    """Where the tokens of documents go; n: lengths, in descending order of n % max(capacities)."""
    most = max(capacities)
    rest, full = n % most, n // most
    some = int(np.count_nonzero(rest))  # they stand first
    bins, offsets, sizes = best_fit(rest[:some].tolist(), capacities)
    long = np.repeat(np.arange(len(n)), full)
    piece = np.arange(len(long)) - np.repeat(np.cumsum(full) - full, full)
    join = lambda a, b: np.concatenate([np.asarray(a, np.int64), np.asarray(b, np.int64)])
    same = np.full(len(long), most)
    return Layout(
        join(np.arange(some), long), join(full[:some], piece), join(full[:some] * most, piece * most), join(rest[:some], same),
        join(bins, len(sizes) + np.arange(len(long))), join(np.asarray(sizes, np.int64)[np.asarray(bins, np.int64)], same), join(offsets, np.zeros(len(long))),
    )


def by_group(batches, at: int):
    """(group, table) for rows that come sorted by the number in column `at`."""
    now, held = None, []
    for b in batches:
        group = b.column(at).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else []
        for a, z in zip(cut[:-1], cut[1:]):
            if group[a] != now:
                if held:
                    yield now, pa.Table.from_batches(held)
                now, held = int(group[a]), []
            held.append(b.slice(a, z - a))
    if held:
        yield now, pa.Table.from_batches(held)


def pack(docs: DataFrame, length: str = "n_tokens", capacities=CAPACITIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin, capacity, offset): a row for each piece of each document of
    (doc_id, length); start is where the piece begins in its document, offset where it lies in its bin."""
    most = max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.lit(0), F.coalesce(F.col(length), F.lit(0))).cast("long").alias("n"))
    groups = max(1, -(-row_count(rows) // group_rows))
    rows = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "n"), F.lit(groups)).cast("int"))
    rows = rows.repartitionById(groups, "group").sortWithinPartitions("group", F.desc(F.col("n") % most), "doc_id", F.desc("n"))
    names = ["doc_id", "piece", "start", "n_tokens", "bin", "capacity", "offset"]

    def run(batches):
        for group, t in by_group(batches, 2):
            ids, n = t["doc_id"].combine_chunks(), t["n"].to_numpy()
            x = layout(n, capacities)
            cols = [x.piece.astype(np.int32), x.start, x.length, (group << 32) + x.bin, x.capacity.astype(np.int32), x.offset.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x.who)), *map(pa.array, cols)], names=names)
            none = np.flatnonzero(n == 0)
            if len(none):
                zero = np.zeros(len(none), np.int64)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(none)), pa.array(zero.astype(np.int32)), pa.array(zero), pa.array(zero), *[pa.nulls(len(none), k) for k in (pa.int64(), pa.int32(), pa.int32())]], names=names)

    return rows.mapInArrow(lean(run), "doc_id long, piece int, start long, n_tokens long, bin long, capacity int, offset int")


def encoded(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, spread, n_tokens, ids): ids of each whole text with an end id, in two bytes each (or four,
    see tokenfile.kind_of); spread tells rows apart that are otherwise equal."""
    from quern.llm.tokenfile import encoder, packed_rows

    def run(batches):
        enc, times = encoder(path), Counter()
        for b in slices(batches, "text", 1 << 20):
            made, n = enc.ended(*text_buffer(b.column(1)), end_id)
            rows = packed_rows(made.astype(enc.kind), n)
            key = [(d, zlib.crc32(x.as_buffer())) for d, x in zip(b.column(0).to_pylist(), rows)]
            spread = []
            for d, crc in key:
                times[d, crc] += 1
                spread.append(crc << 24 ^ times[d, crc])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spread, pa.int64()), pa.array(n), rows], names=["doc_id", "spread", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(lean(run, (("encoder", path),)), "doc_id long, spread long, n_tokens long, ids binary")


def sequences(docs: DataFrame, path: str, end_id: int = 0, capacities=CAPACITIES, group_rows: int = GROUP_ROWS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(bin, capacity, n_tokens, doc_ids, starts, lengths, ids): a row for each packed sequence.  ids are its
    tokens, little-endian, in two bytes each (or four, see tokenfile.kind_of); the three lists say which
    document each part comes from, where it begins there and how many tokens it has."""
    from tokenizers import Tokenizer

    from quern.llm.tokenfile import kind_of, packed_rows

    kind, most = kind_of(Tokenizer.from_file(path)), max(capacities)
    size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()  # a byte-level token has a byte or more
    groups = max(1, -(-size[0] // group_rows), -(-(size[1] or 0) // (4 * group_tokens)))
    rows = encoded(docs, path, end_id).withColumn("group", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(groups)).cast("int"))
    rows = rows.repartitionById(groups, "group").sortWithinPartitions("group", F.desc(F.col("n_tokens") % most), "doc_id", F.desc("n_tokens"), "spread")
    names = ["bin", "capacity", "n_tokens", "doc_ids", "starts", "lengths", "ids"]

    def run(batches):
        for group, t in by_group(batches, 4):
            ids, n = t["doc_id"].combine_chunks(), t["n_tokens"].to_numpy()
            flat, off = text_buffer(t["ids"])
            flat, off = flat.view(kind), off // np.dtype(kind).itemsize
            x = layout(n, capacities)
            order = np.lexsort((x.offset, x.bin))
            lead = np.flatnonzero(np.diff(x.bin[order], prepend=-1))
            parts = pa.array(np.append(lead, len(order)).astype(np.int32))
            used = np.add.reduceat(x.length[order], lead) if len(lead) else lead
            begin = (off[:-1][x.who] + x.start)[order]
            tokens = np.concatenate([flat[a:z] for a, z in zip(begin.tolist(), (begin + x.length[order]).tolist())] or [flat])
            lists = [pa.ListArray.from_arrays(parts, v) for v in (ids.take(pa.array(x.who[order])), pa.array(x.start[order]), pa.array(x.length[order].astype(np.int32)))]
            cols = [pa.array((group << 32) + x.bin[order][lead]), pa.array(x.capacity[order][lead].astype(np.int32)), pa.array(used.astype(np.int32)), *lists, packed_rows(tokens, used)]
            whole = pa.RecordBatch.from_arrays(cols, names=names)
            for at in range(0, whole.num_rows, 256):
                yield whole.slice(at, 256)

    return rows.mapInArrow(lean(run), "bin long, capacity int, n_tokens int, doc_ids array<long>, starts array<long>, lengths array<int>, ids binary")


def digests(packed: DataFrame) -> DataFrame:
    """sequences(), with the crc32 of the ids instead of them."""
    return packed.select("bin", "capacity", "n_tokens", "doc_ids", "starts", "lengths", F.crc32("ids").alias("ids_crc32"))
