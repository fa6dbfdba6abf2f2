"""From raw documents to packed training sequences, stage by stage.

Every stage takes the documents its predecessor kept and returns documents again, the last one
packed pieces. ``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import alignment, jaccard, packing, pseudonyms, quality
from vacantia.llm.queries import PSEUDONYM_KEY, table
from vacantia.llm.shared import shared_path


def _with_length(documents: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        documents = documents.withColumn("n_chars", F.length("text").cast("long"))
    return documents.select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ordinal classifier (1): documents not probably of the top grade go."""
    model = quality.fit(docs, quality.grades(table(spark, sf_dir, "labels")))
    return quality.accepted(quality.score(docs, model)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (4): blocks of an earlier document go; so do documents of which nothing is left."""
    cut = alignment.dedup_lines(docs)
    left = cut.filter("n_deleted = 0 OR text RLIKE '\\\\S'")
    return _with_length(left, docs.columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jaccard join (8): of each class of linked documents the one with the smallest id stays."""
    return jaccard.one_per_class(docs, jaccard.similar_documents(docs))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms (3) in place of personal data."""
    return _with_length(pseudonyms.pseudonymize(docs, PSEUDONYM_KEY), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (2) into sequences of 2048 tokens."""
    return packing.pack(packing.pieces(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    ))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("pii_pseudonyms", hide_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Tokenising, alignment and the classifier cannot be said in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = shared_path(spark, name)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
