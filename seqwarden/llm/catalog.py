"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seqwarden.catalog import Query
from seqwarden.llm import byte_bpe, html_text, language, lm_score, merkle, mixing, packing, periodic_runs, pii, sharding, simhash, vectors, whitening

BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PII_KEY = "a key for the sample tables"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.with_pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), sharding.shard_names(256))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.train(docs))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked_vectors(table(spark, sf_dir, "embeddings"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~language.held_out()))
    predicted = language.identify(docs, model)
    return predicted.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "coverage")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_periods(table(spark, sf_dir, "documents"))))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def llm_queries() -> list[Query]:
    return [
        Query("op1_feistel_pseudonyms", op1),
        Query("op2_poisson_mixing", op2, mixing.mix_sql()),
        Query("op3_lookup_sharding", op3),
        Query("op4_tag_path_text", op4),
        Query("op5_masked_pseudo_likelihood", op5),
        Query("op6_simhash_near_duplicates", op6),
        Query("op7_pstable_vector_links", op7),
        Query("op8_language_bitmask_filters", op8),
        Query("op9_best_fit_packing", op9),
        Query("op10_merkle_fingerprints", op10, merkle.fingerprints_sql()),
        Query("op11_byte_bpe_tree", op11),
        Query("op12_periodic_runs", op12),
        Query("op13_embedding_whitening", op13),
        Query("pipeline", corpus_pipeline.run),
    ]
