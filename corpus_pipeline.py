"""From raw documents to a tokenised training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep
the columns of ``documents``. Language ID drops texts without a recognised language, the
n-gram join keeps one document of each group of near copies, personal data is masked, the
sources are mixed to their target weights (a document comes as often as the mix reads it),
and the texts are encoded with a byte-level BPE and decoded again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import bpe, langid, mixing, ngram_join, pii
from gradeloom.session import shared_folder

#: Texts whose best language is less likely than this are rejected.
LEAST_PROBABILITY = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, LEAST_PROBABILITY)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_personal_data(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: Language ID is learnt, so SQL cannot express the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
