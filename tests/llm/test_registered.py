"""Each registered query of the subpackage as it stands: columns, types, and what its contract says."""

import hashlib
import os
import sys
import zlib

import numpy as np
import pytest

from quern.llm import queries

sys.path.insert(0, os.path.dirname(__file__))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "embeddings", "pages", "labels")}


def run(spark, name, *columns):
    df = queries.queries()[name](spark, SF)
    types = dict(df.dtypes)
    for c in columns:
        n, t = c.split()
        assert types[n] == t, (n, types[n])
    return df.collect()


def test_op1(spark, tables):
    rows = run(spark, "op1_vp_tree", "query_id bigint", "rank int", "vec_id bigint", "score double")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in tables["embeddings"]}
    hit = total = 0
    for q in (i for i in x if i % 20 == 0):
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r.score - (x[q] * x[r.vec_id]).sum()) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own) and q not in {r.vec_id for r in own}
        best = sorted((-(x[q] * v).sum(), i) for i, v in x.items() if i != q)[:20]
        hit, total = hit + len({i for _, i in best} & {r.vec_id for r in own}), total + 20
    assert len(rows) == total and hit >= 0.9 * total


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    assert sorted(map(repr, map(tuple, df.select(*[d[0] for d in want.description]).collect()))) == sorted(map(repr, want.fetchall()))


def test_op3(spark, tables):
    from quern.llm.tokenfile import Encoder

    rows = sorted(run(spark, "op3_token_files", "doc_id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint"), key=lambda r: r.doc_id)
    lib, at = Encoder(queries.tokenizer_path("byte_bpe_50k.json")).tokenizer, 0
    docs = sorted(tables["documents"], key=lambda d: d.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    for r, d in zip(rows, docs):
        ids = np.array([*lib.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op5(spark, tables):
    rows = run(spark, "op5_best_fit", "bin bigint", "capacity int", "n_tokens int", "doc_ids array<bigint>", "ids_crc32 bigint")
    assert {d for r in rows for d in r.doc_ids} == {d.doc_id for d in tables["documents"]} and all(r.n_tokens <= r.capacity for r in rows)
    from test_packing import plain

    from quern.llm import packing
    from quern.llm.tokenfile import Encoder

    enc, most = Encoder(queries.tokenizer_path("byte_bpe_50k.json")), max(packing.CAPACITIES)
    sizes = [len(enc.encode(d.text or "")) // 4 + 1 for d in tables["documents"]]  # few enough for one group
    want = plain(sorted((n % most for n in sizes if n % most), reverse=True), packing.CAPACITIES, packing.sequence_cost)
    want += [(most, (most,))] * sum(n // most for n in sizes)
    assert sorted((r.capacity, tuple(r.lengths)) for r in rows) == sorted(want)


@pytest.mark.parametrize("name, label, threshold", [("op6_toxicity", "toxic", 0.5), ("op8_quality", "quality", 0.3)])
def test_op6_op8(spark, tables, name, label, threshold):
    """Accuracy and recall over rows that were held out, on the larger table, as the smallest has few."""
    rows = {r.doc_id: r for r in run(spark, name, "doc_id bigint", "held_out boolean", "score double", "predicted int")}
    assert rows.keys() == {d.doc_id for d in tables["documents"]}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for i, r in rows.items())
    larger = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.queries()[name](spark, larger).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for i, r in rows.items())
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{larger}/labels.parquet").collect() if r[label] is not None and r.doc_id in rows and rows[r.doc_id].held_out}
    assert len(known) > 50 and np.mean([rows[i].predicted == y for i, y in known.items()]) > 0.95
    positive = [i for i, y in known.items() if y == 1]
    assert np.mean([rows[i].predicted for i in positive]) > 0.6 and np.mean([rows[i].predicted for i, y in known.items() if y == 0]) < 0.05


def test_op7(spark, tables):
    import test_minhash

    rows = run(spark, "op7_minhash", "doc_id bigint", "n_shingles bigint", "component_id bigint", "kept boolean")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == test_minhash.brute([(d.doc_id, d.text) for d in tables["documents"]], 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_op9(spark, tables):
    from quern.llm.piece import Pieces

    rows = {r.doc_id: r for r in run(spark, "op9_piece_stream", "doc_id bigint", "n_ids bigint", "ids_crc32 bigint", "same boolean")}
    lib = Pieces(queries.tokenizer_path("piece_bpe_32k.model")).lib
    for d in tables["documents"]:
        ids = np.array(lib.encode(d.text or ""), "<u4")
        assert (rows[d.doc_id].n_ids, rows[d.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())) and rows[d.doc_id].same


def test_op10(spark, tables):
    import test_bwt

    rows = run(spark, "op10_suffix_dedup", "doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string")
    assert sorted((tuple(r)[:5] for r in rows), key=str) == test_bwt.brute([(d.doc_id, d.text) for d in tables["documents"]])
    assert any(r.kept_sha256 == hashlib.sha256(d.text.encode()).hexdigest() for r in rows for d in tables["documents"][:5])
