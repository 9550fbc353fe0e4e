"""A pipeline for training data: language, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of ``documents``. ``run`` writes every stage as Parquet and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwarden.llm import language, mixing, near_copies, packing, pii
from seqwarden.session import materialize

#: Learning takes labelled rows only; a text is rejected if no language explains this share of its n-grams.
MIN_COVERAGE = 0.15
PII_KEY = "a key for the sample tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that are in no learned language.

    The filters are learned from the labelled rows of ``documents``. The rejected text is
    decided from the text alone, so rows with an equal text share the decision. ``lang`` stays as it is.
    """
    model = language.fit(_table(spark, sf_dir, "documents").filter(~language.held_out()))
    return language.keep_identified(docs, model, MIN_COVERAGE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (5-word shingles, Jaccard 0.8 or more): the one with the smallest id.

    Of several such rows the first by hash of the text stays. A group whose ids are all null keeps one row; texts of
    different groups stay even if they share an id.
    """
    return near_copies.drop_similar(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text; ``n_chars`` is the new text's, which has the same length or nearly so."""
    changed = pii.with_pseudonyms(docs, PII_KEY, n_values="_n_values", kinds="_kinds")
    length = F.when(F.col("_n_values") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents a Poisson number of times, so that sources get weights in proportion to the root of their size."""
    return mixing.mix(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2,048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", pseudonymise),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Learned filters, SimHash, Feistel networks and a tokenizer have no equal in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
