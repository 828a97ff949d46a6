"""Corpus pipeline: toxic documents go, one of each group of near copies stays, personal data is replaced, sources are
mixed to their targets, and the result is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firmnet.llm import apportion, disclosure, packing, simhash, toxicity
from firmnet.llm.common import table
from firmnet.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return disclosure.sanitised(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apportion.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenised_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                                  public_tokenizers.path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("pii", replace_personal_data),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
# Classifiers, fingerprints, tokens and seeded choices are outside SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
