"""A corpus from raw documents to token ids: five stages, each over all that the one before has kept.

Each stage is a function of (session, documents, folder of tables).  Its result is written as Parquet and
read again as the next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm import bagminhash, bpe, mixing, queries, secrets, toxicity
from stocklens.session import landed

#: Wanted shares of tokens by language.  They are near the present ones, and nothing is thinned out: texts
#: of languages that fall short are repeated.
MIX = {"en": 0.7, "de": 0.12, "fr": 0.1, "es": 0.08}


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not reject."""
    model = toxicity.fit(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model, queries.TOXIC_LEAST)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return bagminhash.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and their length counted anew."""
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of scarce languages as often as their rate says."""
    labelled = queries.domains_of_labelled(docs, queries.table(spark, sf_dir, "labels"))
    return mixing.repeated(docs, labelled, MIX)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``token_ids`` of every document."""
    return bpe.encode(docs, public_tokenizers.path(queries.MULTI_VOCABULARY))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: Learned models, verified hashing and token ids cannot be stated in SQL; the tests hold brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
