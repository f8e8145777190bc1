"""Exact dedup by an index of live digests behind cuckoo filters.

A text's key is the sha256 of its bytes without white space.  Keys are dealt by their last bytes to shards; a
shard has a cuckoo filter (Fan et al., 2014), buckets of four 16-bit fingerprints, and beside each
fingerprint the number of the stored key that it stands for: the bucketed content.  A fingerprint
that is met is only a hint: the key stored at its place is compared in full.  Keys of texts that are
withdrawn leave their place again; when a key finds none, the table is doubled and filled anew from the stored
keys.

1. One pass over the texts makes (digest, doc_id, n_chars) for each row, written as a table.
2. Tasks bring equal digests of FLUSH rows together before the shuffle, so a text with very many copies
   sends a row for each such portion and not for each copy.
3. A task for each shard reads its filter and stored keys, then what has come; misses become new keys,
   verified hits are added to theirs.  It writes the shard's next version.
4. Rows are joined with the groups of more than one row; all others stand for themselves.

Groups keep how many rows they have, and the row that stays: most code points, then smallest doc_id.
delete() takes rows out by the same way: groups whose keeper goes are made anew from the rows that
are left, groups without any leave the filter.  find() asks the filters first, and only hits meet keys.

Defined cases: null and empty texts, and such as hold white space alone, are one group; rows that repeat a
doc_id are rows of their own, of equal ones (doc_id, text and length) one stays; a row without a doc_id stands behind all
others of its length, its keep_id is null where it stays; an empty table gives an empty one; withdrawing
what was never inserted changes nothing.  2^63 - 1 stands for no doc_id."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import discard, expanded, lean, materialise, mix, row_count, slices, text_buffer

#: Rows of a task whose equal digests are brought together; rows to a shard, about; moves to find a place.
FLUSH, SHARD_ROWS, KICKS = 1 << 16, 1 << 18, 200
#: Slots of a bucket, and the share of all slots that is filled at most.
SLOTS, FULL = 4, 0.8
NO_ID = np.iinfo(np.int64).max
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


# ---------------------------------------------------------------- keys


def keys_of(data: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(sha256 without white space, code points of the whole text) of each text of a buffer."""
    dark = ~_SPACE[data]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.concatenate([[0], np.cumsum(dark)])[off]
    left = memoryview(np.ascontiguousarray(data[dark]))
    digests = [hashlib.sha256(left[a:z]).digest() for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return digests, points[off[1:]] - points[off[:-1]]


def digested(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars) of every row."""

    def run(batches):
        for b in slices(batches, "text"):
            digests, n = keys_of(*text_buffer(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(n, pa.int64())], names=["doc_id", "digest", "n_chars"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, digest binary, n_chars long")


def words(column: pa.Array) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    data, _ = text_buffer(column)
    return np.frombuffer(data.tobytes(), "<u8").reshape(-1, 4)


def grouped(key: np.ndarray, n: np.ndarray, chars: np.ndarray, doc: np.ndarray, twins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of equal keys as one: their number, and the best (most characters, then smallest doc_id) with
    how many rows are just that one."""
    order = np.lexsort((doc, -chars, key[:, 0], key[:, 1], key[:, 2], key[:, 3]))
    key, n, chars, doc, twins = key[order], n[order], chars[order], doc[order], twins[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    best = (chars == chars[first][group]) & (doc == doc[first][group])
    add = lambda x: np.add.reduceat(x, first) if len(first) else x
    return key[first], add(n), chars[first], doc[first], add(np.where(best, twins, 0))


# ---------------------------------------------------------------- a shard's index


class Cuckoo:
    """Fingerprints in buckets of SLOTS, each with the number of the key that is stored for it."""

    def __init__(self, buckets: int = 256):
        self.keys = np.zeros((0, 4), U64)
        self.free: list[int] = []
        self.place = np.zeros(0, np.int64)  # of each key: bucket * SLOTS + slot, -1 if it is not live
        self.resizes = 0
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = np.zeros(buckets * SLOTS, np.uint16)
        self.held = np.full(buckets * SLOTS, -1, np.int32)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix(mark.astype(U64)) & U64(self.buckets - 1)).astype(np.int64)

    def _homes(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket); a fingerprint is never 0, which marks an empty slot."""
        mark = (key[:, 1] % U64(65535)).astype(np.uint16) + np.uint16(1)
        one = (key[:, 0] & U64(self.buckets - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def hinted(self, key: np.ndarray) -> np.ndarray:
        """Whether the filter alone says that a key may be live: no false negatives."""
        mark, one, two = self._homes(key)
        slots = np.arange(SLOTS)
        return ((self.marks[one[:, None] * SLOTS + slots] == mark[:, None]) | (self.marks[two[:, None] * SLOTS + slots] == mark[:, None])).any(1)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key that is live, or -1: hits of the filter, compared in full."""
        out = np.full(len(key), -1, np.int64)
        mark, one, two = self._homes(key)
        for home in (one, two):
            for slot in range(SLOTS):
                at = home * SLOTS + slot
                hit = np.flatnonzero((self.marks[at] == mark) & (out < 0))
                own = self.held[at[hit]]
                out[hit] = np.where((self.keys[own] == key[hit]).all(1), own, -1) if len(hit) else -1
        return out

    def insert(self, key: np.ndarray) -> np.ndarray:
        """Store distinct keys that are not live; returns their numbers."""
        back = [self.free.pop() for _ in range(min(len(self.free), len(key)))]
        fresh = len(self.keys) + np.arange(len(key) - len(back))
        number = np.concatenate([np.array(back, np.int64), fresh]).astype(np.int64)
        self.keys = np.concatenate([self.keys, key[len(back) :]])
        self.place = np.concatenate([self.place, np.full(len(fresh), -1, np.int64)])
        self.keys[number] = key
        buckets = self.buckets
        while len(self) + len(number) > FULL * SLOTS * buckets:
            buckets *= 2
        if buckets > self.buckets:
            self._grow(buckets)
        elif not self._put(number):
            self._grow(2 * buckets)  # places all keys that are stored, those too that had found none
        return number

    def __len__(self) -> int:
        return int((self.place >= 0).sum())

    def _put(self, number: np.ndarray) -> bool:
        """Give places to stored keys; False if one found none."""
        mark, one, two = self._homes(self.keys[number])
        for home in (one, two):
            open_ = np.flatnonzero(self.place[number] < 0)
            order = open_[np.argsort(home[open_], kind="stable")]
            h = home[order]
            nth = np.arange(len(h)) - np.searchsorted(h, h, "left")
            empty = self.marks.reshape(-1, SLOTS)[h] == 0
            fits = empty.sum(1) > nth
            slot = np.argmax((np.cumsum(empty, 1) == (nth + 1)[:, None]) & empty, 1)
            at, i = (h * SLOTS + slot)[fits], order[fits]
            self.marks[at], self.held[at], self.place[number[i]] = mark[i], number[i], at
        return all(self._kick(int(number[i]), int(mark[i]), int(one[i])) for i in np.flatnonzero(self.place[number] < 0).tolist())

    def _kick(self, number: int, mark: int, bucket: int) -> bool:
        """Move others to their second bucket until one more fits; False leaves a key that was moved
        without a place."""
        for step in range(KICKS):
            row = self.marks[bucket * SLOTS : (bucket + 1) * SLOTS]
            empty = np.flatnonzero(row == 0)
            slot = int(empty[0]) if len(empty) else (number + step) % SLOTS
            at = bucket * SLOTS + slot
            out_mark, out = int(self.marks[at]), int(self.held[at])
            self.marks[at], self.held[at], self.place[number] = mark, number, at
            if len(empty):
                return True
            self.place[out] = -1
            number, mark = out, out_mark
            bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
        return False

    def _grow(self, buckets: int) -> None:
        """So many buckets, or more, filled from the stored keys."""
        stored = np.ones(len(self.keys), bool)
        stored[self.free] = False
        placed = False
        while not placed:
            self.resizes += 1
            self._empty(buckets)
            self.place[:] = -1
            placed = self._put(np.flatnonzero(stored))
            buckets *= 2

    def delete(self, number: np.ndarray) -> None:
        """Live keys leave their places, which later ones may take."""
        at = self.place[number]
        self.marks[at], self.held[at], self.place[number] = 0, -1, -1
        self.free += number.tolist()

    def filter_bytes(self) -> bytes:
        return self.marks.tobytes()

    @classmethod
    def of_filter(cls, raw: bytes) -> Cuckoo:
        """The filter alone, for hinted()."""
        out = cls(len(raw) // 2 // SLOTS)
        out.marks = np.frombuffer(raw, np.uint16)
        return out

    @classmethod
    def of(cls, raw: bytes, key: np.ndarray, place: np.ndarray) -> Cuckoo:
        out = cls(len(raw) // 2 // SLOTS)
        out.marks = np.frombuffer(raw, np.uint16).copy()
        out.keys, out.place = key.copy(), place.copy()
        out.held[place] = np.arange(len(key))
        return out


# ---------------------------------------------------------------- the operator

_GROUP = "n long, n_chars long, keep_id long, twins long"
_STATE = f"shard int, kind int, digest binary, {_GROUP}, place long, filter binary"
#: What a row of a shard is: its filter, a stored key, a group to add, a group to put in place of what is there.
FILTER, KEY, ADD, REPLACE = range(4)


def shard_of(digest, shards: int):
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def partial_groups(rows: DataFrame) -> DataFrame:
    """(digest, n, n_chars, keep_id, twins) of FLUSH rows at a time, where they lie."""

    def run(batches):
        held, size = [], 0

        def out():
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ones = np.ones(b.num_rows, np.int64)
            key, n, chars, doc, twins = grouped(words(b.column(1)), ones, b.column(2).to_numpy(), b.column(0).fill_null(NO_ID).to_numpy(), ones)
            return pa.RecordBatch.from_arrays([_digests(key), *map(pa.array, (n, chars)), _ids(doc), pa.array(twins)], names=["digest", "n", "n_chars", "keep_id", "twins"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= FLUSH:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return rows.select("doc_id", "digest", "n_chars").mapInArrow(lean(run), f"digest binary, {_GROUP}")


def _ids(doc: np.ndarray) -> pa.Array:
    return pa.array(doc, pa.int64(), mask=doc == NO_ID)


def _digests(key: np.ndarray) -> pa.Array:
    ends = pa.py_buffer((np.arange(len(key) + 1) * 32).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(key), [None, ends, pa.py_buffer(np.ascontiguousarray(key, "<u8"))])


def next_state(rows: DataFrame, shards: int) -> DataFrame:
    """The next version of each shard that has rows: (shard, kind, ...) of filters, keys and changes."""

    def finished(shard, raw, stored, come, anew):
        """stored: (key, n, chars, doc, twins, place); come and anew: (key, n, chars, doc, twins)."""
        index = Cuckoo.of(raw, stored[0], stored[5]) if raw is not None else Cuckoo()
        n, chars, doc, twins = (np.array(x, np.int64) for x in stored[1:5])

        def place_for(key):
            nonlocal n, chars, doc, twins
            number = index.find(key)
            new = np.flatnonzero(number < 0)
            number[new] = index.insert(key[new])
            more = np.zeros(len(index.keys) - len(n), np.int64)
            n, chars, doc, twins = (np.concatenate([x, more]) for x in (n, chars, doc, twins))
            return number, new

        if come is not None:
            key, a, c, d, t = grouped(*come)
            i, new = place_for(key)
            n[i[new]], chars[i[new]], doc[i[new]], twins[i[new]] = 0, -1, NO_ID, 0
            better = (c > chars[i]) | ((c == chars[i]) & (d < doc[i]))
            same = (c == chars[i]) & (d == doc[i])
            n[i] += a
            twins[i] = np.where(better, t, np.where(same, twins[i] + t, twins[i]))
            chars[i], doc[i] = np.where(better, c, chars[i]), np.where(better, d, doc[i])
        if anew is not None:
            key, a, c, d, t = anew
            lost = index.find(key[a == 0])
            index.delete(lost[lost >= 0])
            key, a, c, d, t = (x[a > 0] for x in (key, a, c, d, t))
            i, _ = place_for(key)
            n[i], chars[i], doc[i], twins[i] = a, c, d, t
        live = np.flatnonzero(index.place >= 0)
        count = len(live) + 1
        column = lambda x, t=pa.int64(): pa.concat_arrays([pa.nulls(1, t), x])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(count, shard, np.int32)), pa.array(np.r_[FILTER, np.full(len(live), KEY)].astype(np.int32)), column(_digests(index.keys[live]), pa.binary()),
            *[column(x) for x in (pa.array(n[live]), pa.array(chars[live]), _ids(doc[live]), pa.array(twins[live]), pa.array(index.place[live]))],
            pa.concat_arrays([pa.array([index.filter_bytes()], pa.binary()), pa.nulls(len(live), pa.binary())]),
        ], names=["shard", "kind", "digest", "n", "n_chars", "keep_id", "twins", "place", "filter"])

    def run(batches):
        now, parts = None, []

        def done():
            t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            kind = t.column(1).to_numpy()
            figures = [t.column(c).fill_null(NO_ID).to_numpy() for c in (3, 4, 5, 6, 7)]

            def of(k):
                a, z = np.searchsorted(kind, [k, k + 1])
                return (words(t.column(2).slice(a, z - a)), *[f[a:z] for f in figures])

            raw = t.column(8)[0].as_py() if kind[0] == FILTER else None
            some = lambda k: of(k)[:5] if (kind == k).any() else None
            yield from finished(now, raw, of(KEY), some(ADD), some(REPLACE))

        for b in batches:
            shard = b.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)] if len(shard) else []
            for a, z in zip(cut[:-1], cut[1:]):
                if now is not None and shard[a] != now:
                    yield from done()
                    parts = []
                now = int(shard[a])
                parts.append(b.slice(a, z - a))
        if parts:
            yield from done()

    return rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(run), _STATE)


class DigestIndex:
    """Live rows (doc_id, digest, n_chars) and, by shard, their groups behind cuckoo filters.

    Tables in the shared folder: `rows` with a sign (1: came, -1: went) for each change, and the state of
    all shards, of which the last written counts.  shards: fixed by the first insert."""

    def __init__(self, spark: SparkSession, shards: int | None = None):
        self.spark, self.shards = spark, shards
        self.rows: DataFrame | None = None
        self.state: DataFrame | None = None

    def _noted(self, docs: DataFrame, sign: int) -> DataFrame:
        batch = materialise(digested(docs).withColumn("sign", F.lit(sign)), "digest-rows")
        self.rows = batch if self.rows is None else self.rows.unionByName(batch)
        return batch

    def _changed(self, groups: DataFrame, kind: int) -> None:
        rows = groups.select(shard_of(F.col("digest"), self.shards).alias("shard"), F.lit(kind).alias("kind"), "digest", "n", "n_chars", "keep_id", "twins", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("filter"))
        before = self.state
        self.state = materialise(next_state(rows if before is None else before.unionByName(rows), self.shards), "digest-state")
        if before is not None:
            discard(before)

    def insert(self, docs: DataFrame) -> None:
        """Every row of docs (doc_id, text) becomes live."""
        batch = self._noted(docs, 1)
        if self.shards is None:
            self.shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-row_count(batch) // SHARD_ROWS))
        self._changed(partial_groups(batch), ADD)

    def live(self) -> DataFrame:
        """(doc_id, digest, n_chars, copies): rows that came more often than they went."""
        net = self.rows.groupBy("doc_id", "digest", "n_chars").agg(F.sum("sign").alias("copies"))
        return net.where("copies > 0")

    def delete(self, docs: DataFrame) -> None:
        """Rows of docs (doc_id, text) that are live are live no longer; each row takes one away."""
        if self.state is None:
            return
        went = digested(docs).groupBy("doc_id", "digest", "n_chars").agg(F.count(F.lit(1)).alias("lost"))
        have = self.live().withColumnRenamed("doc_id", "_d")
        own = went.join(have, (F.col("_d").eqNullSafe(F.col("doc_id"))) & (went["digest"] == have["digest"]) & (went["n_chars"] == have["n_chars"]))
        taken = own.select("doc_id", went["digest"], went["n_chars"], (-F.least("lost", "copies")).cast("int").alias("sign"))
        batch = materialise(taken, "digest-rows")
        self.rows = self.rows.unionByName(batch)
        touched = batch.select("digest").distinct()
        left = self.live().join(touched, "digest", "left_semi")
        order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id")
        best = left.groupBy("digest").agg(F.sum("copies").alias("n"), F.min(F.struct(order.alias("o"), "n_chars", "doc_id", "copies")).alias("b"))
        best = best.select("digest", "n", F.col("b.n_chars").alias("n_chars"), F.col("b.doc_id").alias("keep_id"), F.col("b.copies").alias("twins"))
        anew = touched.join(best, "digest", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        self._changed(anew, REPLACE)

    def groups(self) -> DataFrame:
        """(digest, n, n_chars, keep_id, twins) of every live key; twins: rows equal to the one that stays."""
        return self.state.where(F.col("kind") == KEY).select("digest", "n", "n_chars", "keep_id", "twins")

    def find(self, docs: DataFrame) -> DataFrame:
        """(doc_id, keep_id): rows of docs whose text is live, with the row that stays for it.  The filters
        are asked first; only what they let pass meets stored keys."""
        rows = materialise(digested(docs), "digest-asked")
        asked = rows.select("digest").distinct().select(shard_of(F.col("digest"), self.shards).alias("shard"), F.lit(KEY).alias("kind"), "digest", F.lit(None).cast("binary").alias("filter"))
        filters = self.state.where(F.col("kind") == FILTER).select("shard", "kind", "digest", "filter")

        def run(batches):
            now, held = None, None
            for b in batches:
                shard, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
                cut = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(shard)] if len(shard) else []
                for a, z in zip(cut[:-1], cut[1:]):
                    part = b.slice(a, z - a)
                    if kind[a] == FILTER:
                        now, held = int(shard[a]), Cuckoo.of_filter(part.column(3)[0].as_py())
                    elif held is not None and now == shard[a]:
                        yield pa.RecordBatch.from_arrays([part.column(2).filter(pa.array(held.hinted(words(part.column(2)))))], names=["digest"])

        both = filters.unionByName(asked).repartitionById(self.shards, "shard").sortWithinPartitions("shard", "kind")
        hits = both.mapInArrow(lean(run), "digest binary")
        return rows.join(hits.join(self.groups().select("digest", "keep_id"), "digest"), "digest").select("doc_id", "keep_id")

    def verdicts(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of each live row."""
        signs = self.rows
        went = not signs.where("sign < 0").isEmpty()
        rows = expanded(self.live(), "copies", "copy").drop("copies", "copy") if went else signs.drop("sign")
        many = self.groups().where("n > 1").select("digest", F.col("n").alias("group_size"), F.col("n_chars").alias("most"), "keep_id", "twins")
        wide = rows.join(many, "digest", "left")
        alone = F.col("group_size").isNull()
        best = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("most")))
        wide = wide.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), best.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.coalesce("twins", F.lit(1)).alias("twins"))
        columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        if many.where("twins > 1").isEmpty():
            return wide.select(*columns)
        twins = F.col("kept") & (F.col("twins") > 1)  # equal rows, of which one stays
        same = wide.where(twins).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
        one = expanded(same, "copies", "copy").withColumn("kept", F.col("copy") == 0)
        return wide.where(~twins).select(*columns).unionByName(one.select(*columns))


def deduplicated(docs: DataFrame) -> DataFrame:
    """verdicts() of an index that holds all of docs."""
    index = DigestIndex(docs.sparkSession)
    index.insert(docs)
    return index.verdicts()
