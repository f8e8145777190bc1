"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bwt, cuckoo, kmeans, mih, minhash, packing, piece, quality, resample, sql, tokenfile, toxicity, urlfilter, vptree
from quern.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(read_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read_table(spark, sf_dir, "pages"), urlfilter.rules_table(spark))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_output(spark, read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest by Hamming distance of the signs, for vec_ids divisible by 100."""
    return mih.top_k(read_table(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences of the permitted lengths, with the crc32 of their ids."""
    return packing.digests(packing.sequences(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), 0.5)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), 0.3)


def op9_piece_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.round_trips(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.digests(read_table(spark, sf_dir, "documents"))


def op11_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.deduplicated(read_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=25, seed=7, least_words=20)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.clusters(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


def queries() -> dict:
    named = (op1_vp_tree, op2_url_filter, op3_token_files, op4_multi_index, op5_best_fit, op6_toxicity, op7_minhash, op8_quality, op9_piece_stream, op10_suffix_dedup, op11_cuckoo_dedup, op12_importance_resampling, op13_centroids)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": sql.URL_FILTER, "op4_multi_index": sql.MULTI_INDEX, "op11_cuckoo_dedup": sql.EXACT_DEDUP, "op12_importance_resampling": sql.RESAMPLE, "op13_centroids": sql.centroids()}
