import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import test_bwt
import test_minhash

import corpus_pipeline


def corpus(spark, path):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs, labels = [], []
    for i in range(160):
        t = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        toxic = i % 8 == 1
        if toxic:
            t.insert(3, "worthless")
            t.insert(5, "scum")
        text = " ".join(t)
        low = i % 8 == 3
        if low:
            text = "!! ".join(t).upper() + "###" * 20
        if i % 8 == 6:
            text = f"{text} é{passage}ß {i}"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not low), int(toxic)))
        if i % 8 == 4:
            docs.append((1000 + i, text + " tail", "en", "s", len(text) + 5))
            docs.append((2000 + i, text, "en", "s", len(text)))
    docs += [(3000, None, None, None, None), (3001, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {i: y for i, _, y in labels}, {i: q for i, q, _ in labels}


def test_every_stage(spark, tmp_path):
    toxic, good = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "repeated_passages", "packing"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        out.write.parquet(f"{tmp_path}/stage{n}")
        out = spark.read.parquet(f"{tmp_path}/stage{n}")
        after = {} if name == "packing" else {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            gone = before.keys() - after.keys()
            assert gone == {i for i, y in toxic.items() if y}
        elif name == "quality":
            gone = before.keys() - after.keys()
            assert {i for i, q in good.items() if not q} <= gone and not gone & {i for i, q in good.items() if q}
        elif name == "near_duplicates":
            want = {d for d, _, c in test_minhash.brute(list(before.items()), 5, 80) if d == c}
            assert after.keys() == want and 3000 in want and not any(d in after for d in range(2004, 2160))
        elif name == "repeated_passages":
            want = {d: n - r for d, n, r, _, _ in test_bwt.brute(list(before.items()))}
            assert after.keys() == before.keys()
            assert all(0 <= want[d] - len((after[d] or "").encode()) <= 3 for d in after)
            assert any(len((before[d] or "").encode()) > want[d] for d in want)
        else:
            rows = out.collect()
            assert {d for r in rows for d in r.doc_ids} == before.keys() and all(sum(r.lengths) == r.n_tokens <= r.capacity for r in rows)
        docs, before = out, after
    assert corpus_pipeline.ORACLE_SQL is None


CLASH = ("score", "kept", "n_removed", "n_bytes", "n_spans", "k0", "kind", "block", "place", "group", "_text", "Label")


def test_columns_of_any_name_nulls_and_repeated_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.unionByName(docs.where("doc_id = 4").withColumn("text", F.lit("another text under the same id")))
    docs = docs.withColumns({c: F.concat(F.lit(c), F.lit(" of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH})
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.count() > 0
            continue
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/clash{n}")
        docs = spark.read.parquet(f"{tmp_path}/clash{n}")
        rows = docs.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in CLASH)
        ids = [(r.doc_id, r.text) for r in rows if r.doc_id is not None]
        assert None in [r.doc_id for r in rows]
        assert (len(ids) == len(set(ids))) == (n >= 2)
        assert any(r.doc_id == 4 and r.text == "another text under the same id" for r in rows)


@pytest.mark.parametrize("others", [[], [(9, "w" * 30)] * 3 + [(30, None), (30, ""), (30, None)]])
def test_near_copies_under_a_repeated_doc_id(spark, others):
    """Whatever else repeats in the table: a near copy goes, a text of its own stays, equal rows are one."""
    words = lambda a, n=60: " ".join(f"{a}{i}" for i in range(n))
    t, u, v = words("t"), words("u"), words("v")
    rows = [(1, t), (5, t + " end"), (5, u), (6, u + " more"), (7, v), (7, v + " tail"), (8, v), (None, t), *others]
    docs = spark.createDataFrame([(d, x, f"of {d}") for d, x in rows], "doc_id long, text string, text_key string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == docs.columns and len(got) == len(set(got))
    own = [r for r in got if r[0] in (1, 5, 6, 8, None)]
    assert sorted(own, key=str) == sorted([(1, t), (5, u), (None, t)], key=str)
    assert len([r for r in got if r[0] == 7]) == 1 and len([r for r in got if r[0] in (9, 30)]) == (2 if others else 0)


def test_empty_table(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run_goes_through_all_stages(spark, tmp_path):
    corpus(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {d for r in rows for d in r.doc_ids}
    assert 0 in kept and 1 not in kept and 3 not in kept and 2004 not in kept
