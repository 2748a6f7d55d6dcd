"""The ``opN_<name>`` queries over the whole tables and, where SQL has it, their oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gru_lm, hashing_ann, langid, mixing, ngram_join, quality, secret_scan, sharding, voronoi_knn
from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True)


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), host=F.col("source"), path=F.concat_ws("/", "source", "lang"))


def op3_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.top_inner_products(table(spark, sf_dir, "embeddings"), k=10, scale=1024)


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing_ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), k=10)


def op5_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.withColumn("held_out", langid.held_out(docs))
    return langid.learn_and_identify(found, keep=("doc_id", "held_out"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes")


def op8_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=8)


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_site_quality, op3_voronoi_top_k, op4_multi_index_hashing, op5_randomness_secrets, op6_rank_order_language, op7_mix_sources, op8_gated_recurrent_lm, op9_ngram_jaccard, op10_shard_by_bytes)}
ORACLES: dict[str, str] = {}
