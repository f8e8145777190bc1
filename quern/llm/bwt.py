"""Repeated passages by merging the Burrows-Wheeler transforms of shards.

A byte is removed if a string of `size` (50) bytes that covers it also starts in a document with a
smaller doc_id.  The work is cut by content, so that equal strings always meet:

1. Every `size`-byte window takes as its key the least hash of the `gram`-byte strings in it; equal
   windows have equal keys, and neighbouring windows mostly share one, so windows form runs.  A
   grouped pass over packed keys finds those that occur in more than one document, and tells each
   block of documents which of its keys these are.
2. Runs with such keys become snippets, dealt by key to buckets.  Equal snippets of a block go there
   once, with the block's smallest doc_id: a place in a larger document is covered by that one, so
   its span is settled on the spot.  A passage that stands in every document thus costs a bucket one
   place a block.  Keys with more than HOT entries are dealt window by window instead, by the
   window's own hash; this spreads the work and changes no result.
3. In a bucket the snippets, each once, lie in shards.  Each shard gets its Burrows-Wheeler
   transform (its suffixes in order of their first `size` bytes, and the two bytes before each).
   The transforms are merged by iterative interleave refinement (Holt and McMillan, 2014): the
   interleave in order of h bytes is dealt stably by the bytes before each suffix, which gives the
   interleave of h + 2 bytes; no suffix is compared or sorted again.  The round in which a boundary
   between neighbours first appears gives their common prefix; maximal runs whose common prefixes reach
   `size` bytes are the repeated intervals.  The smallest doc_id of each goes back to all places of
   its windows.  A snippet that is its key's only one has no other to be merged with.
4. Spans go back to the documents, where they are united and cut out.

Snippets are equal if all their bytes are; hashes only bring them together.  Blocks and buckets hold
some BLOCK bytes of text each, counted first, whatever the size of the input; a bucket is worked off in
parts of PART bytes, cut between keys, so memory stays bounded.  Texts travel to their block as
compressed record batches.  Spans are written in the shared folder before they go back to the
documents; nothing but counts reaches the driver.

Defined cases: null and empty texts have no bytes and lose none; matches never cross documents;
rows with equal doc_id take nothing from one another; a null doc_id counts as larger than any;
columns to keep may have any names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import U64, lean, materialise, mix, ranges, slices, span_hash, text_buffer, words_at

SIZE, GRAM = 50, 24
HOT = 50_000
BLOCK = 8 << 20
PART, SHARD = 4 << 20, 1 << 17
SLICE = 1 << 19
#: Bytes of text whose keys, or bytes of snippets, that are put together before they are handed on.
FLUSH = 16 << 20
END = 0xFF  # not a byte of UTF-8
LAST = np.iinfo(np.int64).max

# ---------------------------------------------------------------- transforms and their merge


def shard_transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, before): rotations of a shard in order of their first `depth` bytes, and the two
    bytes before each as one number.  Ranks of 8 bytes are doubled until they cover the depth."""
    n = len(text)
    ext = np.resize(text, n + 8)
    word = np.zeros(n, U64)
    for j in range(8):
        word = (word << U64(8)) | ext[j : j + n]
    covered = 8
    while True:
        order = np.argsort(word)
        word = word[order]
        new = np.concatenate([[False], word[1:] != word[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if covered >= depth or np.count_nonzero(new) == n - 1:
            break
        step = min(covered, depth - covered)
        word = (rank.astype(U64) << U64(32)) | np.roll(rank, -(step % n)).astype(U64)
        covered += step
    one, two = np.roll(text, 1)[order], np.roll(text, 2)[order]
    return order, (two.astype(np.uint16) << 8) | one


def interleave(before: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge shard transforms; returns (place, common): for each suffix, shard after shard in shard
    order, its place in the merged order, and at each place the bytes (an even number, `depth` or
    more if no boundary was found) that its suffix shares with the one before."""
    bwt = np.concatenate(before)
    shard = np.repeat(np.arange(len(before), dtype=np.uint8), [len(b) for b in before])
    block = np.zeros(len(bwt), np.int32)
    common = np.full(len(bwt), depth, np.uint8)
    c = np.empty(len(bwt), np.uint16)
    place = np.arange(len(bwt))
    blocks = 1
    for h in range(0, depth, 2):
        c[place] = bwt  # the j-th suffix of a shard, in its own order
        order = np.argsort(c, kind="stable")
        shard, now, block = shard[order], c[order], block[order]
        place = np.argsort(shard, kind="stable")
        new = (now[1:] != now[:-1]) | (block[1:] != block[:-1])
        block[0] = 0
        np.cumsum(new, out=block[1:])
        np.minimum(common[1:], np.where(new, np.uint8(h), np.uint8(depth)), out=common[1:])
        if block[-1] + 1 == blocks:  # no block was split: none will be
            break
        blocks = int(block[-1]) + 1
    if len(common):
        common[0] = 0
    return place, common


def repeats(text: np.ndarray, starts: np.ndarray, size: int = SIZE, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(position, interval) of the windows of snippets, in merged order: interval is equal for equal
    windows.

    text: snippets, each followed by END; starts: where each snippet begins."""
    n = len(starts)
    ends = np.concatenate([starts[1:], [len(text)]])
    width = max(shard, len(text) // 250 + 1)  # shard numbers fit a byte
    cut = np.unique(np.concatenate([[0], np.searchsorted(starts, np.arange(width, len(text), width)), [n]]))
    order, before = [], []
    for a, b in zip(cut[:-1], cut[1:]):
        o, p = shard_transform(text[starts[a] : ends[b - 1]], size)
        order.append(o + starts[a])
        before.append(p)
    place, common = interleave(before, size)
    position = np.empty(len(text), np.int64)
    position[place] = np.concatenate(order)
    interval = np.cumsum(common < size)
    room = np.zeros(len(text) + 1, np.int64)
    room[starts] += 1
    room[np.maximum(ends - size, starts)] -= 1  # a window needs `size` bytes before END
    valid = np.cumsum(room[:-1]) > 0
    keep = valid[position]
    return position[keep], interval[keep]




# ---------------------------------------------------------------- runs of windows


def gram_hash(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on."""
    word, m = words_at(data), len(data) - gram + 1
    out = np.zeros(m, U64)
    for j in range(0, gram, 8):
        part = word[j : j + m] if gram - j >= 8 else word[j : j + m] & U64((1 << 8 * (gram - j)) - 1)
        out ^= out >> U64(29)
        out += part
        out *= U64(0x9E3779B97F4A7C15)
    out ^= out >> U64(32)
    return out


def window_runs(data: np.ndarray, off: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """(key, document, first, last): maximal runs of window starts with one key."""
    empty = np.zeros(0, np.int64)
    if len(data) < size:
        return empty.astype(U64), empty, empty, empty
    low = gram_hash(data, gram)
    width, have = size - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    fits = np.ones(len(low) + 1, bool)  # windows that end in the document they begin in
    across = (off[1:, None] - np.arange(1, size)).ravel()
    fits[across[(across >= 0) & (across < len(low))]] = False
    fits[-1] = False
    same = np.zeros(len(low) + 1, bool)  # as the window before
    same[1:-1] = (low[1:] == low[:-1]) & fits[:-2]
    first = np.flatnonzero(fits & ~same)
    last = np.flatnonzero(fits[:-1] & ~(same[1:] & fits[1:]))
    return mix(low[first]), np.searchsorted(off, first, "right") - 1, first, last


def dealt(key: np.ndarray, buckets: int) -> np.ndarray:
    """bucket * 2^32 + a number below 2^32; ascends with the key."""
    n = U64(buckets)
    return (key >> U64(32)) * n + (((key & U64(0xFFFFFFFF)) * n) >> U64(32))


def groups(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    if not len(values):
        return []
    cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(cut[:-1], cut[1:]))


def alike(key: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): snippets by key and content; new marks the first of each kind of equal ones.
    Hashes bring equal snippets together; those that stand together are compared byte by byte."""
    content = span_hash(text, start, start + length)
    order = np.lexsort((content, key))
    k, c, s, n = key[order], content[order], start[order], length[order]
    same = np.concatenate([[False], (k[1:] == k[:-1]) & (c[1:] == c[:-1]) & (n[1:] == n[:-1])])
    rows = np.flatnonzero(same)
    step = max(1, (1 << 20) // max(1, int(length.max()))) if len(rows) else 1
    for at in range(0, len(rows), step):
        r = rows[at : at + step]
        differs = text[ranges(s[r], n[r])] != text[ranges(s[r - 1], n[r])]
        if differs.any():
            same[r[np.maximum.reduceat(differs, np.cumsum(n[r]) - n[r])]] = False
    return order, ~same


@functools.lru_cache(1)
def _codec():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(a: np.ndarray, climbs: bool = False) -> bytes:
    """An array's bytes, all first ones, all second ones, ..., compressed; the steps of one that climbs."""
    if climbs:
        a = np.diff(a, prepend=a.dtype.type(0))
    a = np.ascontiguousarray(a)
    return _codec()[0].compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def _unpack(raw: bytes, kind, climbs: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    a = np.frombuffer(_codec()[1].decompress(raw), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()
    return np.cumsum(a, dtype=kind) if climbs else a


# ---------------------------------------------------------------- the stages


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _packed(base: DataFrame, n: int) -> DataFrame:
    """(block, pack): the rows of base (rid, doc_id, text, ...), those of a block together, as compressed
    record batches; and the schema of these."""
    schema = base.limit(0).toArrow().schema

    def run(batches):
        for b in slices(batches, "text", FLUSH // 2):
            if b.schema != schema:
                b = b.cast(schema)
            block = np.mod(b.column(0).to_numpy(), n)
            order = np.argsort(block, kind="stable")
            for a, z in groups(block[order]):
                some = b.take(pa.array(order[a:z]))
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(block[order[a]])], pa.int32()), "pack": [_codec()[0].compress(some.serialize())]})

    return base.mapInArrow(lean(run), "block int, pack binary"), schema


def _opened(pack: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(_codec()[1].decompress(pack)), schema)


def _keys(base: DataFrame, n: int, size: int, gram: int) -> DataFrame:
    """Packed (key, block) pairs of the texts, by bucket: one for each document that has the key, two at
    most for a block."""
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("blocks", pa.binary())])

    def run(batches):
        held, blocks, rows, volume = [], [], 0, 0

        def flush():
            key, doc = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            order = np.argsort(key, kind="stable")  # documents of a key ascend
            key, doc = key[order], doc[order]
            own = np.ones(len(key), bool)
            own[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, block = key[own], np.concatenate(blocks)[doc[own]]
            crowd = np.zeros(len(key), bool)  # keys with more than two documents
            for d in (0, 1, 2):
                crowd[d : len(key) - 2 + d] |= key[2:] == key[:-2]
            idx = np.flatnonzero(crowd)
            idx = idx[np.lexsort((block[idx], key[idx]))]
            k, b = key[idx], block[idx]
            keep = np.ones(len(key), bool)
            keep[idx[2:][(k[2:] == k[:-2]) & (b[2:] == b[:-2])]] = False
            key, block = key[keep], block[keep]
            return _batch(schema, [(int(key[a] >> U64(32)), _pack((key[a:z]).astype(np.uint32), True), _pack(block[a:z])) for a, z in groups(key >> U64(32))])

        for b in slices(batches, "text", SLICE):
            data, off = text_buffer(b.column(1))
            key, doc, _, _ = window_runs(data, off, size, gram)
            held.append((dealt(key, n), doc + rows))
            blocks.append(np.mod(b.column(0).to_numpy(), n).astype(np.uint8 if n <= 256 else np.uint32))
            rows += b.num_rows
            volume += len(data)
            if volume >= FLUSH:
                yield flush()
                held, blocks, rows, volume = [], [], 0, 0
        if held:
            yield flush()

    return base.select("rid", "text").mapInArrow(lean(run), "bucket int, keys binary, blocks binary")


def _shared(keys: DataFrame, n: int, hot: int) -> DataFrame:
    """For each block: which of its keys more than one document has."""
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("hot", pa.binary())])

    def run(batches):
        held: list = []

        def flush(bucket):
            key = np.concatenate([_unpack(x[0], np.uint32, True) for x in held])
            block = np.concatenate([_unpack(x[1], np.uint8 if n <= 256 else np.uint32) for x in held])
            order = np.argsort(key, kind="stable")
            key, block = key[order], block[order]
            count = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
            each = np.repeat(count, count)
            on = each > 1
            key, block, each = key[on], block[on], each[on]
            order = np.lexsort((key, block))
            key, block, each = key[order], block[order], each[order]
            own = np.ones(len(key), bool)
            own[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
            key, block, very = key[own], block[own], each[own] > hot
            return _batch(schema, [(int(block[a]), bucket, _pack(key[a:z], True), np.packbits(very[a:z]).tobytes() if very[a:z].any() else None) for a, z in groups(block)])

        now = None
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[0] != now:
                    if held:
                        yield flush(now)
                    held, now = [], row[0]
                held.append(row[1:])
        if held:
            yield flush(now)

    return keys.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "block int, bucket int, keys binary, hot binary")


def _met(replies: DataFrame, packs: DataFrame, n: int) -> DataFrame:
    """Each block's replies (kind 0), then its packs of documents (kind 1)."""
    types = {f.name: f.dataType for f in replies.schema if f.name != "block"}
    left = replies.select("block", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("pack"), *types)
    right = packs.select("block", F.lit(1).alias("kind"), "pack", *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    return left.unionByName(right).repartitionById(n, "block").sortWithinPartitions("block", "kind")


PLACES = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("keys", "sizes", "text", "snip", "doc", "doc_ids", "rids", "at")]])
SPANS = pa.schema([("block", pa.int32()), *[(c, pa.binary()) for c in ("doc_ids", "rids", "firsts", "ends")]])
SPANS_TYPE = "block int, doc_ids binary, rids binary, firsts binary, ends binary"


def _span_rows(block, doc_id, rid, first, end) -> list[tuple]:
    """Rows of SPANS, after uniting what overlaps in a document so far as is known here."""
    order = np.lexsort((first, rid, doc_id, block))
    block, doc_id, rid, first, end = (x[order] for x in (block, doc_id, rid, first, end))
    if len(rid):
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (doc_id[1:] != doc_id[:-1]) | (rid[1:] != rid[:-1]) | (first[1:] > end[:-1])])
        lead = np.flatnonzero(new)
        block, doc_id, rid, first, end = block[lead], doc_id[lead], rid[lead], first[lead], np.maximum.reduceat(end, lead)
    return [(int(block[a]), _pack(doc_id[a:z], True), _pack(rid[a:z]), _pack(first[a:z].astype(np.int32)), _pack(end[a:z].astype(np.int32))) for a, z in groups(block)]


def _snippets(met: DataFrame, schema: pa.Schema, n: int, size: int, gram: int) -> DataFrame:
    """Snippets with shared keys, by bucket: each kind once for a flush of a block, with its places of
    the smallest doc_id; and, without keys, the spans that are covered by these."""

    def flush(block, held, doc_ids, rids):
        key, doc, at, length, text = (np.concatenate([x[i] for x in held]) for i in range(5))
        start = np.cumsum(length) - length
        order, new = alike(key, start, length, text)
        key, doc, at, length, start = (x[order] for x in (key, doc, at, length, start))
        lead = np.flatnonzero(new)
        snip = np.cumsum(new) - 1
        doc_id, rid = np.concatenate(doc_ids), np.concatenate(rids)
        least = np.minimum.reduceat(doc_id[doc], lead)
        later = doc_id[doc] > least[snip]
        out = []
        for row in _span_rows(np.full(np.count_nonzero(later), block), doc_id[doc[later]], rid[doc[later]], at[later], (at + length)[later]):
            out.append((block % n, block, None, row[4], None, None, None, row[1], row[2], row[3]))
        key, doc, at, snip = key[~later], doc[~later], at[~later], snip[~later]
        for a, z in groups(key >> U64(32)):
            kinds, own = np.unique(snip[a:z], return_inverse=True)
            lie, size_of = start[lead[kinds]], length[lead[kinds]]
            some, idx = np.unique(doc[a:z], return_inverse=True)
            by = np.argsort(doc_id[some], kind="stable")
            idx = np.argsort(by)[idx]
            some = some[by]
            out.append((
                int(key[a] >> U64(32)), block, _pack(key[a:z][np.flatnonzero(np.diff(own, prepend=-1))], True), _pack(size_of.astype(np.int32)), _codec()[0].compress(text[ranges(lie, size_of)].tobytes()),
                _pack(own.astype(np.int32), True), _pack(idx.astype(np.int32)), _pack(doc_id[some], True), _pack(rid[some]), _pack(at[a:z].astype(np.int32)),
            ))
        return _batch(PLACES, out)

    def run(batches):
        now, replies, table = None, [], None
        held, doc_ids, rids, rows, volume, seen = [], [], [], 0, 0, set()
        for b in batches:
            for block, kind, pack, bucket, keys, hot in zip(*[c.to_pylist() for c in b.columns]):
                if block != now:
                    if held:
                        yield flush(now, held, doc_ids, rids)
                    now, replies, table = block, [], None
                    held, doc_ids, rids, rows, volume, seen = [], [], [], 0, 0, set()
                if kind == 0:
                    replies.append((bucket, keys, hot))
                    continue
                if table is None:
                    replies.sort(key=lambda r: r[0])
                    own = [_unpack(r[1], np.uint32, True) for r in replies]
                    table = np.concatenate([k.astype(U64) | U64(r[0] << 32) for r, k in zip(replies, own)] or [np.zeros(0, U64)])
                    very = np.concatenate([np.unpackbits(np.frombuffer(r[2], np.uint8))[: len(k)] if r[2] else np.zeros(len(k), np.uint8) for r, k in zip(replies, own)] or [np.zeros(0, np.uint8)])
                    replies = []
                if not len(table):
                    continue
                whole = _opened(pack, schema)
                once = [i for i, r in enumerate(whole.column(0).to_pylist()) if r not in seen and not seen.add(r)]  # a repeated row has the spans of the first
                for part in slices([whole.take(pa.array(once, pa.int64()))], "text", SLICE):
                    data, off = text_buffer(part.column(2))
                    key, doc, lo, hi = window_runs(data, off, size, gram)
                    key = dealt(key, n)
                    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
                    on = table[at] == key
                    key, doc, lo, hi, many = key[on], doc[on], lo[on], hi[on], very[at[on]] > 0
                    if many.any():  # window by window, under a key of its own
                        count = (hi - lo + 1)[many]
                        w, wd = ranges(lo[many], count), np.repeat(doc[many], count)
                        key = np.concatenate([key[~many], dealt(mix(span_hash(data, w, w + size) ^ U64(0x5851F42D4C957F2D)), n)])
                        doc, lo, hi = np.concatenate([doc[~many], wd]), np.concatenate([lo[~many], w]), np.concatenate([hi[~many], w])
                    if len(key):
                        length = hi - lo + size
                        held.append((key, doc + rows, lo - off[doc], length, data[ranges(lo, length)]))
                        doc_ids.append(np.array([LAST if d is None else d for d in part.column(1).to_pylist()], np.int64))
                        rids.append(part.column(0).to_numpy().astype(np.uint32))
                        rows += part.num_rows
                        volume += int(length.sum())
                    if volume >= FLUSH:
                        yield flush(now, held, doc_ids, rids)
                        held, doc_ids, rids, rows, volume = [], [], [], 0, 0
        if held:
            yield flush(now, held, doc_ids, rids)

    return met.mapInArrow(lean(run), "bucket int, block int, keys binary, sizes binary, text binary, snip binary, doc binary, doc_ids binary, rids binary, at binary")


def covered(key, length, text, snip, doc_id, at, size: int = SIZE):
    """(place, first, end): byte spans, by place, that start in a document with a smaller doc_id.

    key, length, text: snippets (equal ones may come from several blocks); snip, doc_id, at: the
    places of each.  Works on parts of about PART bytes, cut between keys."""
    start = np.cumsum(length) - length
    order, new = alike(key, start, length, text)
    one = np.empty(len(key), np.int64)
    one[order] = np.cumsum(new) - 1
    kinds = order[new]  # a snippet for each distinct one, by key
    mine = one[snip]
    least = np.full(len(kinds), LAST)
    by = np.argsort(mine, kind="stable")
    some = np.flatnonzero(np.diff(mine[by], prepend=-1))
    if len(by):
        least[mine[by][some]] = np.minimum.reduceat(doc_id[by], some)
    later = doc_id > least[mine]  # places of a snippet that a smaller document has whole
    spans = [(np.flatnonzero(later), at[later], at[later] + length[kinds][mine[later]])]
    firsts = np.flatnonzero(~later)
    firsts = firsts[np.argsort(mine[firsts], kind="stable")]
    head = np.searchsorted(mine[firsts], np.arange(len(kinds) + 1))
    k = key[kinds]
    apart = np.concatenate([[True], k[1:] != k[:-1], [True]])
    several = np.flatnonzero(~(apart[1:] & apart[:-1]))  # kinds that share their key with another
    size_of = length[kinds[several]] + 1
    total = np.cumsum(size_of)
    group = np.cumsum(np.concatenate([[True], k[several][1:] != k[several][:-1]])) - 1 if len(several) else several
    cut = [0]
    while cut[-1] < len(several):
        goal = (total[cut[-1] - 1] if cut[-1] else 0) + PART
        end = max(int(np.searchsorted(total, goal, "right")), cut[-1] + 1)
        end = int(np.searchsorted(group, group[end - 1], "right"))  # the whole of the last key
        cut.append(end)
    for a, b in zip(cut[:-1], cut[1:]):
        members = several[a:b]
        own = kinds[members]
        begin = np.cumsum(size_of[a:b]) - size_of[a:b]
        body = np.full(int(size_of[a:b].sum()), END, np.uint8)
        body[ranges(begin, length[own])] = text[ranges(start[own], length[own])]
        position, interval = repeats(body, begin, size)
        if not len(position):
            continue
        low = least[members[np.searchsorted(begin, position, "right") - 1]]
        edge = np.flatnonzero(np.diff(interval, prepend=-1))
        smallest = np.repeat(np.minimum.reduceat(low, edge), np.diff(np.concatenate([edge, [len(interval)]])))
        p = np.sort(position[smallest < low])
        if not len(p):
            continue
        new_run = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1] + 1]))
        lo, hi = p[new_run], p[np.concatenate([new_run[1:], [len(p)]]) - 1]
        which = np.searchsorted(begin, lo, "right") - 1
        kind = members[which]
        n = head[kind + 1] - head[kind]
        place = firsts[ranges(head[kind], n)]
        shift = np.repeat(lo - begin[which], n)
        spans.append((place, at[place] + shift, at[place] + shift + np.repeat(hi - lo + size, n)))
    return tuple(np.concatenate([s[i] for s in spans]) for i in range(3))


def _spans(snippets: DataFrame, n: int, size: int) -> DataFrame:
    def run(batches):
        held, now = [], None

        def flush():
            key = np.concatenate([_unpack(r[0], U64, True) for r in held])
            sizes = [_unpack(r[1], np.int32) for r in held]
            base = np.cumsum([0, *map(len, sizes)])
            length = np.concatenate(sizes).astype(np.int64)
            text = np.concatenate([np.frombuffer(_codec()[1].decompress(r[2]), np.uint8) for r in held])
            snip = np.concatenate([_unpack(r[3], np.int32, True).astype(np.int64) + b for r, b in zip(held, base)])
            docs = [_unpack(r[4], np.int32) for r in held]
            doc_id = np.concatenate([_unpack(r[5], np.int64, True)[d] for r, d in zip(held, docs)])
            rid = np.concatenate([_unpack(r[6], np.uint32)[d] for r, d in zip(held, docs)])
            at = np.concatenate([_unpack(r[7], np.int32) for r in held]).astype(np.int64)
            block = np.repeat([r[8] for r in held], [len(d) for d in docs])
            place, first, end = covered(key, length, text, snip, doc_id, at, size)
            return _span_rows(block[place], doc_id[place], rid[place], first, end)

        for b in batches:
            out = []
            for bucket, block, keys, *rest in zip(*[c.to_pylist() for c in b.columns]):
                if keys is None:  # settled in its block
                    out.append((block, rest[4], rest[5], rest[6], rest[0]))
                    continue
                if bucket != now:
                    if held:
                        out += flush()
                    held, now = [], bucket
                held.append((keys, *rest, block))
            yield _batch(SPANS, out)
        if held:
            yield _batch(SPANS, flush())

    return snippets.repartitionById(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), SPANS_TYPE)


def united(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, disjoint, non-touching spans."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return first[new], np.concatenate([end[new[1:] - 1], end[-1:]])


def cut_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, keep: list[str] | None = None, hot: int = HOT, block_bytes: int = BLOCK, characters: bool = False) -> DataFrame:
    """A row for each row of docs (doc_id, text): the columns `keep`, in order, as k0, k1, ..., and
    (n_bytes, n_removed, n_spans, kept binary): the bytes that are left, in order; with `characters`
    kept is a string, and of a character that is cut in two the rest goes as well."""
    keep = ["doc_id"] if keep is None else keep
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // block_bytes))
    own = [F.xxhash64("doc_id", text).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")]
    slim, base = docs.select(*own), docs.select(*own, *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    shared = _shared(_keys(slim, n, size, gram), n, hot)  # read once: its shuffle is all that keeps it
    packs, schema = _packed(slim, n)
    spans = materialise(_spans(_snippets(_met(shared, packs, n), schema, n, size, gram), n, size), "bwt-spans")
    packs, schema = _packed(base, n)

    def run(batches):
        now, replies, table = None, [], None
        for b in batches:
            for block, kind, pack, *spans_of in zip(*[c.to_pylist() for c in b.columns]):
                if block != now:
                    now, replies, table = block, [], None
                if kind == 0:
                    replies.append(spans_of)
                    continue
                if table is None:
                    cols = [np.concatenate([_unpack(r[j], kind_of, j == 0) for r in replies]) if replies else np.zeros(0, kind_of) for j, kind_of in enumerate((np.int64, np.uint32, np.int32, np.int32))]
                    order = np.lexsort((cols[2], cols[1], cols[0]))
                    table, replies = [c[order] for c in cols], []
                for part in slices([_opened(pack, schema)], "text", 4 * SLICE):
                    yield cut(part, table)

    def cut(part: pa.RecordBatch, table: list[np.ndarray]) -> pa.RecordBatch:
        sizes, removed, runs, kept = [], [], [], []
        rids = part.column(0).to_numpy().astype(np.uint32)
        for rid, doc_id, text in zip(rids, part.column(1).to_pylist(), part.column(2)):
            raw = text.as_buffer().to_pybytes()
            doc_id = LAST if doc_id is None else doc_id
            a, z = np.searchsorted(table[0], doc_id, "left"), np.searchsorted(table[0], doc_id, "right")
            same = table[1][a:z] == rid
            first, end = united(table[2][a:z][same].astype(np.int64), table[3][a:z][same].astype(np.int64))
            left, at = [], 0
            for s, e in zip(first.tolist(), end.tolist()):
                left.append(raw[at:s])
                at = e
            left.append(raw[at:])
            sizes.append(len(raw)), removed.append(int((end - first).sum())), runs.append(len(first)), kept.append(b"".join(left))
        own = part.columns[3:]
        names = [*[f"k{i}" for i in range(len(own))], "n_bytes", "n_removed", "n_spans", "kept"]
        left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if characters else pa.array(kept, pa.binary())
        return pa.RecordBatch.from_arrays([*own, *[pa.array(v, pa.int64()) for v in (sizes, removed, runs)], left], names=names)

    types = ", ".join([*[f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "n_bytes long", "n_removed long", "n_spans long", f"kept {'string' if characters else 'binary'}"])
    return _met(spans, packs, n).mapInArrow(lean(run), types)


def digests(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    return cut_repeats(docs, size).select(F.col("k0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).hint("rebalance")
