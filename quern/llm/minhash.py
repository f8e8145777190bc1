"""Near-duplicates by min-max hashing of word shingles, confirmed on the full sets.

Min-max hashing (Ji et al., 2013) keeps both the smallest and the largest value of a set under each
permutation: K hash evaluations give 2K signature values, each equal for two sets with probability
their Jaccard similarity, with less variance than 2K independent minima.

1. Each text becomes its set of 64-bit shingle hashes; documents with the same set form a class,
   and everything after works on classes, so exact copies cost one row however many they are.
2. Bands of `rows` minima, and bands of `rows` maxima, give bucket keys (a permutation's minimum
   and maximum never meet in one band).  With 2K = 128 values in 32 bands of 4, two sets at 0.85
   miss every band with probability 6e-11, at 0.8 with 5e-8.
3. In each bucket every class is paired with the bucket's hub, the class whose buckets hold the
   most others (near copies of one text have that text as hub): pairs grow linearly.  Pairs whose
   signatures agree far too seldom (over six standard deviations below the threshold) are set
   aside; the others are confirmed on full sets.  Links form components.
4. Buckets that still hold several components, in which a link between two others may hide, are
   gone through in blocks: pairs of classes of different components, less those already tried,
   that pass the signature test here and in no earlier bucket they share are held against finer
   signatures (8 times as many permutations, made for these classes only), and those that pass
   against the full sets, in the block itself; then the components are joined.

So every pair that shares a bucket is either in one component already, or confirmed on full sets,
or excluded by its signature; no bucket is capped.  Nothing of this reaches the driver.

Defined cases: null, empty and word-less texts have an empty set, are linked with nothing and form
their own component; texts with fewer words than `width` have their whole word sequence as the one
shingle; repeated rows are copies; a row without doc_id is linked like others but never kept.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import U64, Scratch, lean, mix, slices, span_hash, text_buffer, word_spans
from quern.llm.components import components

#: Permutations x -> a*x + b modulo 2^64 (a odd); each gives a minimum and a maximum.
PERMUTATIONS, ROWS = 64, 4
#: Permutations of the finer signatures, which settle what the others leave open.
FINE = 512
#: Classes of a bucket in one block, at most; into how many blocks even a smaller bucket is cut; neighbours
#: that share a copy of a set.
BLOCK, SPLIT, SPREAD = 4096, 8, 512
#: Bytes of the sets of a bucket's classes in one block, about.
BLOCK_BYTES = 32 << 20
_draw = np.random.Generator(np.random.PCG64(20))
_A = _draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * U64(2) + U64(1)
_B = _draw.integers(0, 1 << 63, PERMUTATIONS, np.uint64)
_FINE_A = _draw.integers(0, 1 << 63, FINE, np.uint64) * U64(2) + U64(1)
_FINE_B = _draw.integers(0, 1 << 63, FINE, np.uint64)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[32, 9, 10, 11, 12, 13]] = False
_STEP = U64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a text buffer."""
    data = _FOLD[data]
    start, end, first = word_spans(_INSIDE[data], off)
    code = span_hash(data, start, end)
    run = np.zeros(max(0, len(code) - width + 1), U64)
    for j in range(width):
        run = run * _STEP + code[j : j + len(run)]
    run = mix(run)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = U64(b - a)
            with np.errstate(over="ignore"):
                for c in code[a:b]:
                    h = h * _STEP + c
            sets.append(mix(np.array([h], U64) ^ U64(b - a)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def signature(s: np.ndarray, a_of: np.ndarray = _A, b_of: np.ndarray = _B) -> np.ndarray:
    """The minima, then the maxima, of a non-empty set under every permutation."""
    low, high = None, None
    for at in range(0, len(s), 2048):
        h = s[at : at + 2048, None] * a_of + b_of
        a, b = h.min(0), h.max(0)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    bands = sig.reshape(-1, ROWS)
    key = np.arange(1, len(bands) + 1, dtype=U64) * _STEP
    for j in range(ROWS):
        key = mix(key ^ bands[:, j]) * _STEP
    return key.view(np.int64)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least_agreement(percent: int, permutations: int = PERMUTATIONS) -> int:
    """Signature values that must agree before a pair is worth its full sets."""
    n, p = 2 * permutations, percent / 100
    return int(n * p - 6.5 * (n * p * (1 - p)) ** 0.5)


def signatures(docs: DataFrame, width: int, text_key: bool = False) -> DataFrame:
    """(doc_id, n_shingles, set_id, sig, bands) of every row, and if asked for the xxhash64 of its text."""

    def run(batches):
        for b in slices(batches, "text"):
            sets = shingle_sets(*text_buffer(b.column(1)), width)
            keys, sigs, ids = [], [], []
            for s in sets:
                if len(s):
                    sig = signature(s)
                    keys.append(band_keys(sig))
                    sigs.append((mix(sig) & U64(255)).astype(np.uint8).tobytes())
                    ids.append(set_id(s))
                else:
                    keys.append(np.zeros(0, np.int64)), sigs.append(None), ids.append(None)
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            made = [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary()), bands]
            yield pa.RecordBatch.from_arrays([*made, *b.columns[2:]], names=["doc_id", "n_shingles", "set_id", "sig", "bands", *b.schema.names[2:]])

    more = [F.xxhash64("text").alias("text_key")] if text_key else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(lean(run), "doc_id long, n_shingles long, set_id binary, sig binary, bands array<long>" + ", text_key long" * text_key)


def agreeing(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in `least` values or more."""
    sig = classes.select("set_id", "sig")
    wide = pairs.join(sig.select(F.col("set_id").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("set_id").alias("a"), F.col("sig").alias("sa")), "a")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array((x == y).sum(1) >= least))

    return wide.select("a", "b", "sa", "sb").mapInArrow(lean(run), "a binary, b binary")


def class_key(first_id: Column, content: Column) -> Column:
    """A class's name: its smallest doc_id, in bytes that sort like it (none: after all others), then the
    digest of its set.  So the least of several classes has the least doc_id."""
    number = F.unhex(F.lpad(F.hex(F.coalesce(first_id, F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.concat(F.when(first_id.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), number, content)


def first_of(key: Column) -> Column:
    number = F.conv(F.hex(F.substring(key, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(Decimal(1 << 63))
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", number.cast("long"))


def content_of(key: Column) -> Column:
    return F.substring(key, 10, 16)


def sets_of(wanted: DataFrame, docs: DataFrame, width: int, fine: bool = False) -> DataFrame:
    """(set_id, shingles, fine) of the classes of wanted (set_id): the full set, and if asked for the finer
    signature.  A class's text is that of its smallest doc_id; of classes without one it is found among the
    rows without one, by its set.  How many classes are wanted has no bound, so none are broadcast."""

    def run(batches):
        for b in slices(batches, "text"):
            sets = shingle_sets(*text_buffer(b.column(1)), width)
            some = [i for i, s in enumerate(sets) if len(s)]
            found = [sets[i] for i in some]
            finer = [(mix(signature(s, _FINE_A, _FINE_B)) & U64(255)).astype(np.uint8).tobytes() if fine else None for s in found]
            cols = [b.column(0).take(pa.array(some, pa.int64())), pa.array(map(set_id, found), pa.binary()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(finer, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["set_id", "content", "shingles", "fine"])

    schema = "set_id binary, content binary, shingles binary, fine binary"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = wanted.withColumn("doc_id", first_of(F.col("set_id")))
    named = texts.join(known.where("doc_id is not null").hint("merge"), "doc_id").select("set_id", "text").mapInArrow(lean(run), schema)
    named = named.where(F.col("content") == content_of(F.col("set_id")))  # another text may have the same doc_id
    loose = texts.where("doc_id is null").select(F.lit(None).cast("binary").alias("set_id"), "text").mapInArrow(lean(run), schema).drop("set_id").dropDuplicates(["content"])
    loose = loose.join(known.where("doc_id is null").select("set_id", content_of(F.col("set_id")).alias("content")), "content")
    columns = ["set_id", "shingles", "fine"]
    return named.select(*columns).unionByName(loose.select(*columns)).dropDuplicates(["set_id"])


def nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sets."""
    both = np.concatenate([x, y])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on the full sets (set_id, shingles).
    Neighbours of one a are dealt in parts of about SPREAD, and its set goes to each part once."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("parts"))
    left = parts.join(full.select(F.col("set_id").alias("a"), F.col("shingles").alias("y")), "a")
    left = left.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("b"), "y")
    right = pairs.join(full.select(F.col("set_id").alias("b"), F.col("shingles").alias("y")), "b").join(parts, "a")
    right = right.select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "b", "y")
    met = left.unionByName(right).repartition("a", "part").sortWithinPartitions("a", "part", "kind")

    def check(batches):
        x = None  # the set of the hub whose neighbours come
        for batch in slices(batches, "y", 4 << 20):
            found = []
            for a, kind, b, y in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)]):
                y = np.frombuffer(y, U64)
                if kind == 0:
                    x = y
                    continue
                if alike(x, y, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return met.mapInArrow(lean(check), "a binary, b binary")


def hidden_links(members: DataFrame, heads: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int, keep: Scratch) -> DataFrame:
    """Links (a, b) that share a bucket, join different components and were not tried with the bucket's hub; gone through in
    blocks of about BLOCK classes and BLOCK_BYTES of their sets.  What passes both signature tests is held against the full sets
    in the block itself, so that pairs that fail are never rows."""
    least, least_fine = least_agreement(percent), least_agreement(percent, FINE)
    at = members.join(labels.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    mixed = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("n > 2 and r0 != r1").select("key", "n")
    at = keep(at.join(mixed, "key").join(heads, "key").where("set_id != a").select("key", "band", "n", "set_id", "root"), "minhash-mixed")
    full = keep(sets_of(at.select("set_id").distinct(), docs, width, fine=True), "minhash-fine")
    size = at.join(full.select("set_id", F.octet_length("shingles").alias("size")), "set_id").groupBy("key").agg(F.sum("size").alias("size"))
    at = at.join(size, "key").join(classes.select("set_id", "sig", "bands").join(full.select("set_id", "fine", "shingles"), "set_id"), "set_id")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES), F.least(F.lit(SPLIT), F.ceil(F.col("n") * SPLIT / BLOCK))).cast("int")
    at = at.withColumn("own", F.pmod(F.xxhash64("set_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    at = at.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "root", "sig", "fine", "bands", "band", "shingles")
    at = at.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def pairs_of(group: list[tuple]) -> list[tuple[bytes, bytes]]:
        left = [g for g in group if g[3] == g[1]]
        right = left if group[0][1] == group[0][2] else [g for g in group if g[3] == g[2]]
        if not left or not right:
            return []
        sig = np.frombuffer(b"".join(g[6] for g in right), np.uint8).reshape(len(right), -1)
        fine = np.frombuffer(b"".join(g[7] for g in right), np.uint8).reshape(len(right), -1)
        code = {r: k for k, r in enumerate({g[5] for g in group})}
        root = np.array([code[g[5]] for g in right])
        joined = np.arange(len(code))  # the component that each has come to in this block
        band = group[0][9]
        earlier = np.array([g[8][:band] for g in right], np.int64).reshape(len(right), band)
        out = []
        for k, g in enumerate(left):
            base = k + 1 if left is right else 0
            own = code[g[5]]
            idx = np.flatnonzero(joined[root[base:]] != joined[own]) + base
            if len(idx):
                idx = idx[(sig[idx] == np.frombuffer(g[6], np.uint8)).sum(1) >= least]
            if len(idx) and band:
                idx = idx[~(earlier[idx] == np.array(g[8][:band], np.int64)).any(1)]
            if len(idx):
                idx = idx[(fine[idx] == np.frombuffer(g[7], np.uint8)).sum(1) >= least_fine]
            for m in idx.tolist():
                other = root[m]
                if joined[other] != joined[own] and alike(np.frombuffer(g[10], U64), np.frombuffer(right[m][10], U64), percent):
                    joined[joined == joined[other]] = joined[own]
                    out.append((min(g[4], right[m][4]), max(g[4], right[m][4])))
        return out

    def run(batches):
        held, now = [], None
        for b in batches:
            found = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:3] != now:
                    if len(held) > 1:
                        found += pairs_of(held)
                    held, now = [], row[:3]
                held.append(row)
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})
        if len(held) > 1 and (found := pairs_of(held)):
            yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return at.mapInArrow(lean(run), "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text).

    rows: for tables where a doc_id has several texts, which components may share as their smallest; then
    kept is true of the rows of one class in each component only, that which has its smallest doc_id, and two
    columns tell rows apart: set_id, the digest of the row's set (null: empty), and text_key, the xxhash64 of its text."""
    keep = Scratch()
    least = least_agreement(percent)
    sig = keep(signatures(docs, width, rows), "minhash-signatures")
    classes = sig.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = keep(classes.select(class_key(F.col("first_id"), F.col("set_id")).alias("set_id"), "sig", "bands"), "minhash-classes")
    spread = classes.select("set_id", F.posexplode("bands").alias("band", "key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keep(spread.join(shared, "key").select("key", "band", "n", "set_id"), "minhash-members")
    reach = members.groupBy("set_id").agg(F.sum("n").alias("reach"))
    heads = keep(members.join(reach, "set_id").groupBy("key").agg(F.max_by("set_id", F.struct("reach", "set_id")).alias("a")), "minhash-hubs")
    members = members.drop("n")
    star = members.join(heads, "key").where("set_id != a").select("a", F.col("set_id").alias("b")).distinct()
    star = keep(agreeing(star, classes, least), "minhash-star")
    full = keep(sets_of(nodes_of(star), docs, width), "minhash-sets")
    links = keep(confirmed(star, full, percent), "minhash-links")
    labels = keep.own(components(links))
    hidden = hidden_links(members, heads, labels, classes, docs, width, percent, keep)
    hidden = keep(hidden, "minhash-hidden")
    if not hidden.isEmpty():
        labels = keep.own(components(links.unionByName(hidden)))
    named = classes.select("set_id").join(labels.select(F.col("node").alias("set_id"), "root"), "set_id", "left")
    whole = F.coalesce("root", "set_id")
    named = named.select(content_of(F.col("set_id")).alias("set_id"), first_of(whole).alias("component_id"), *([(F.col("set_id") == whole).alias("first")] if rows else []))
    out = sig.select("doc_id", "n_shingles", "set_id", *(["text_key"] if rows else [])).join(named, "set_id", "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    stays = F.coalesce(F.col("doc_id") == component, F.lit(False))
    if rows:
        stays = stays & F.coalesce("first", F.lit(True))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), stays.alias("kept"), *(["set_id", "text_key"] if rows else []))
    return keep.result(out, "minhash-result")
