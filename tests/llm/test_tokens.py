import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quern.llm import memo, piece, tokenfile
from quern.llm.common import text_buffer
from quern.llm.queries import tokenizer_path

ODD = ["", "  ", "a  b\n c \n  d<|endoftext|> x", "  x \x1c y  ", "don't we'll naïve — “q” x.’s it...#*, ĀĆ 12a3 a_b É.É", " a b", "\n\n a　 b", "日本語 текст 🙂 x", "a" * 300, "word " * 500, "        eight", "the\ttab", "\x00\x01", "====== -----____", "| a | b |", "!!Wow!! (x)\" ok"]


def test_pieces_of_the_encoder_join_to_the_librarys_ids(monkeypatch):
    monkeypatch.setattr(memo, "RECENT", 20)
    enc = tokenfile.Encoder(tokenizer_path("byte_bpe_50k.json"), keep=50)
    rng = random.Random(3)
    bits = ["a", " ", "  ", "the", "Straße", "\n", "\t", "é", "\u00a0", "\u3000", "\u1680x", "'s", "1", ".", "\x00", "日", "🙂", "ab\x00", "internationalisation of ", "'", "'re", "Ü", "×", "²", "œ", "\r", "\x0b", "\x1c", "\x7f", "a\u0301", "<|endoftext|>" * (rng.random() < 0.1), "-", "(", "\u2028", "Æs"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    want = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(enc.encode(t), "<u4").tolist() for t in texts] == want
        ids, count = enc.buffer(*text_buffer(pa.array(texts)))
        assert ids.tolist() == [i for w in want for i in w] and count.tolist() == [len(w) for w in want]
        ids, count = enc.ended(*text_buffer(pa.array(texts)), 70_000)
        assert ids.tolist() == [i for w in want for i in [*w, 70_000]]
    assert len(enc.memo.old) + len(enc.memo.new) <= 80


def test_memo_tells_pieces_apart(monkeypatch):
    """Pieces that hash alike, or that differ in zero bytes only, keep their own ids."""
    monkeypatch.setattr(memo, "mix", lambda x: x & np.uint64(1))
    pieces = [b"a", b"a\0", b"a\0\0", b"b", b"c" * 8, b"c" * 9, b"c" * 23, b"c" * 24, b"c" * 90, b"\0", b"d" * 16]
    data, ends = np.frombuffer(b"".join(pieces * 2), np.uint8), np.cumsum([len(p) for p in pieces * 2])
    asked = []

    def encode(some):
        asked.extend(some)
        n = np.array([1 + pieces.index(p) % 3 for p in some])
        return np.repeat([pieces.index(p) for p in some], n).astype(np.uint16), n

    m = memo.PieceMemo(encode)
    for _ in range(2):
        ids, count = m.ids(data, ends - np.diff(ends, prepend=0), ends)
        assert ids.tolist() == [i for _ in range(2) for i in range(len(pieces)) for _ in range(1 + i % 3)]
    assert len(asked) > len(pieces)


def test_file_round_trip_random_access_and_checksums():
    rng = np.random.default_rng(0)
    docs = [(i, rng.integers(0, 50_000, n).astype("<u4").tobytes()) for i, n in enumerate([0, 5, 4000, 1, 90_000, 3, 3])] + [(None, b"\1\0\0\0")]
    out = io.BytesIO()
    assert tokenfile.write_file(out, iter(docs), frame_bytes=9000) == (8, sum(len(x) for _, x in docs) // 4)
    f = tokenfile.TokenFile(out)
    assert [x for _, x in f.documents()] == [x for _, x in docs]
    f.reads = 0
    assert f.document(4).tobytes() == docs[4][1] and f.document(1).tobytes() == docs[1][1] and f.reads == 2
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(out.getvalue())
    assert whole.startswith(b"".join(x for _, x in docs))
    raw = bytearray(out.getvalue())
    raw[int(f.at[f.frame_of[4]]) + 500] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.TokenFile(io.BytesIO(raw)).document(4)


def test_table_round_trip(spark):
    rows = [(i * 7 % 40, ODD[i % len(ODD)], "x") for i in range(40)] + [(3, "same id", "y"), (None, "no id", "z"), (50, None, "n")]
    path = tokenizer_path("byte_bpe_50k.json")
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = sorted(tokenfile.token_output(spark, df, path).collect(), key=lambda r: r.start)
    lib = tokenfile.Encoder(path).tokenizer
    want = []
    for d, t, _ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [r.doc_id for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert tokenfile.token_output(spark, df.where("false"), path).count() == 0


def test_one_id_over_several_files(spark):
    """A third of the rows under one doc_id, a third under none: dealt over files, in order all the same."""
    rows = [(7, f"seven {i}", None) for i in range(60)] + [(None, f"none {i}", None) for i in range(60)] + [(i, f"own {i}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string")
    path = tokenizer_path("byte_bpe_50k.json")
    manifest = tokenfile.write_token_files(df, path, files=8)
    assert manifest.count() == 8 and manifest.agg({"n_docs": "max"}).first()[0] < 60
    got = tokenfile.read_token_files(manifest).orderBy("start").collect()
    key = [(r.doc_id if r.doc_id is not None else tokenfile.NO_ID) for r in got]
    assert key == sorted(key) and len(got) == 180
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()


def test_document_larger_than_a_frame(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_BYTES", 1000)
    rows = [(i, "long words of a text " * n) for i, n in enumerate([1, 3000, 2, 1000, 0])]
    got = {r.doc_id: r for r in tokenfile.token_output(spark, spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json")).collect()}
    lib = tokenfile.Encoder(tokenizer_path("byte_bpe_50k.json")).tokenizer
    for i, t in rows:
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_streaming_search_equals_the_library():
    m = piece.Pieces(tokenizer_path("piece_bpe_32k.model"))
    assert m.merged
    for t in ODD:
        assert m.encode(t) == m.lib.encode(t)
        assert [i for part in m.stream(m.lib.normalize(t)) for i in part] == m.lib.encode(t)
        assert m.decode(m.encode(t)) == t


def test_commitments_come_early_and_change_nothing():
    m = piece.Pieces(tokenizer_path("piece_bpe_32k.model"))
    text = m.lib.normalize("interchangeable" * 200)
    parts = list(m.stream(text))
    assert len(parts) > 20 and max(map(len, parts)) < 40


@pytest.mark.parametrize("portion", [1, 7, 100, 1 << 16])
def test_portions_equal_the_library(monkeypatch, portion):
    """Cut anywhere: between characters that belong to one piece, in stretches longer than a portion, at the ends."""
    monkeypatch.setattr(piece, "PORTION", portion)
    m = piece.Pieces(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(5)
    texts = [*ODD, "interchangeable" * 300, "x" * 1000 + " y", " ".join(rng.choice(["the", "国", "naïve", "un", "😀", "a\x00b", "  "]) for _ in range(300))]
    for t in texts:
        assert [int(i) for own in m.portions(t) for i in own] == m.lib.encode(t)
    ids, count = m.encode_all(texts)
    assert ids.tolist() == [i for t in texts for i in m.lib.encode(t)] and count.tolist() == [len(m.lib.encode(t)) for t in texts]
    m.plain = False
    assert [int(i) for own in m.portions(texts[-1]) for i in own] == m.lib.encode(texts[-1])


def test_whole_documents_are_committed_as_they_come():
    """On the test table the search hands on what is settled, and few characters are ever open."""
    import pyarrow.parquet as pq

    m = piece.Pieces(tokenizer_path("piece_bpe_32k.model"))
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    for t in texts:
        assert [int(i) for own in m.portions(t) for i in own] == m.lib.encode(t)
    assert m.committed > 1000 and m.widest <= 2 * m.longest


def test_a_long_text_holds_a_portion_at_most(spark):
    """50 MB: what the search holds besides the text follows the portion, not the text; the query's path gives the library's ids."""
    import tracemalloc

    m = piece.Pieces(tokenizer_path("piece_bpe_32k.model"))
    unit = "Some words of a long text, naïve and all. " * 40
    text = unit * (50_000_000 // len(unit))
    one = m.lib.encode(unit + unit)
    tracemalloc.start()
    n = sum(len(own) for own in m.portions(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and n == len(m.lib.encode(unit)) + (len(one) - len(m.lib.encode(unit))) * (50_000_000 // len(unit) - 1)
    long = unit * 300
    r = piece.round_trips(spark.createDataFrame([(1, long), (2, "x" * 200_000)], "doc_id long, text string"), tokenizer_path("piece_bpe_32k.model")).collect()
    for row, t in zip(sorted(r), (long, "x" * 200_000)):
        ids = np.array(m.lib.encode(t), "<u4")
        assert (row.n_ids, row.ids_crc32, row.same) == (len(ids), zlib.crc32(ids.tobytes()), True)


def test_unigram_scores_give_the_best_sum():
    m = piece.Pieces(tokenizer_path("piece_bpe_32k.model"))
    m.merged = False
    m.score = [-float(len(p)) ** 0.5 - (i % 97) / 50 for i, p in enumerate(m.piece)]
    m.floor = -50.0
    for text in ("▁the▁strengthening▁of▁international", "▁aaaaabbbbb▁zq", "▁" + "relation" * 12):
        ids = [i for part in m.stream(text) for i in part]
        best = [0.0] + [-np.inf] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - m.longest), e):
                p = text[s:e]
                if p in m.id:
                    best[e] = max(best[e], best[s] + m.score[m.id[p]])
        assert abs(sum(m.score[i] for i in ids) - best[-1]) < 1e-9 and "".join(m.piece[i] for i in ids) == text


def test_pieces_table(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in piece.decode(piece.encode(df, path), path).collect()}
    assert all(back[i] == t for i, t in enumerate(ODD)) and back[99] == ""
    assert all(r.same for r in piece.round_trips(df, path).collect()) and piece.round_trips(df.where("false"), path).count() == 0


@pytest.mark.parametrize("base", [2**60, 2**53 + 1, -(2**62)])
def test_large_doc_ids_keep_their_order(spark, base):
    """Ids that are one apart beyond what doubles tell apart, one of them repeated, in several files."""
    rng = np.random.default_rng(2)
    rows = [(base + int(i), f"text {i} " * int(i % 5 + 1)) for i in rng.permutation(300)] + [(base + 50, f"again {i}") for i in range(200)] + [(None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = tokenizer_path("byte_bpe_50k.json")
    manifest = tokenfile.write_token_files(docs, path, files=7)
    got = tokenfile.read_token_files(manifest).collect()
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert len(got) == len(rows) and ids[0] is None and ids[1:] == sorted(d for d, _ in rows if d is not None)
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    assert manifest.count() > 4


def test_files_follow_the_bytes_of_the_input(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, str(np.random.default_rng(i).bytes(500))) for i in range(400)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tokenfile.file_count(docs) == least
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 20_000)
    assert tokenfile.file_count(docs) > 3 * least
    assert tokenfile.file_count(spark.createDataFrame(docs.rdd, docs.schema)) == least  # nothing known of its size
