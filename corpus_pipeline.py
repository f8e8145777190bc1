"""The corpus pipeline: toxicity, quality, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs; all but the last return the columns of documents.  The
classifiers learn from sf_dir's documents and labels (rows that are not held out), so a stage's
verdict on a document does not depend on what an earlier stage dropped.

Defined cases, by stage: a null text scores as an empty one, has no near-duplicates, loses no passages
and packs as its end token alone; rows that repeat a doc_id are judged one by one (of equal rows the
near-duplicates stage keeps one); rows without a doc_id are scored, kept by the near-duplicates
stage, give nothing to and take from all others in the passages stage and are packed; an empty table gives
an empty one; columns besides doc_id and text are carried along whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bwt, minhash, packing, quality, toxicity
from quern.llm.common import discard, fresh, materialise, read_table
from quern.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier (0.5) rejects go."""
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    name = fresh(docs, "score")
    return toxicity.score(docs, model, name=name).where(F.col(name) < 0.5).drop(name)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (0.3) rejects go."""
    model = quality.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    name = fresh(docs, "score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.3).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose sets of five-word shingles are 0.8 alike, the row with
    the smallest doc_id stays.  A row is judged by its own text, whatever other rows have its doc_id: of two
    texts under one doc_id both stay if they are not alike, and neither if both are like an earlier
    document's.  Where several rows could stay (the smallest doc_id repeated, with texts of one set, or
    without words), one does.  Rows without a doc_id stay as they are."""
    judged = minhash.near_duplicates(docs.where("doc_id is not null"), width=5, percent=80, rows=True)  # a written table
    key, row = fresh(docs, "text_key"), fresh(docs, "row")
    stays = judged.where("kept").groupBy("doc_id", "set_id").agg(F.min("text_key").alias(key), F.count(F.lit(1)).alias("n"))
    here = docs.withColumn(key, F.xxhash64("text"))
    once = here.join(stays.select("doc_id", key), ["doc_id", key], "left_semi").select(*here.columns)
    if not stays.where("n > 1").isEmpty():  # of equal rows one: the others stay as they are
        again = stays.where("n > 1").select("doc_id", key)
        equal = here.join(again, ["doc_id", key], "left_semi").groupBy("doc_id", key).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
        once = here.join(stays.where("n = 1").select("doc_id", key), ["doc_id", key], "left_semi").select(*docs.columns).unionByName(equal)
    return once.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in 50-byte strings that a document with a smaller doc_id has too are cut out; of a
    character that is cut in two the rest goes as well.  Every document stays, n_chars is new."""
    kept = [c for c in docs.columns if c != "text"]
    left = bwt.cut_repeats(docs, keep=kept, characters=True)
    now = {c: F.col(f"k{i}") for i, c in enumerate(kept)} | {"text": F.col("kept")}
    if "n_chars" in now:
        now["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return left.select(*[now[c].alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed token sequence, with the documents that it holds parts of."""
    return packing.sequences(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Trained classifiers, exact set similarity and packing are beyond SQL; tests/llm holds every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
