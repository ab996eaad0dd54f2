"""The corpus pipeline: each stage reads the documents that the one before it kept.

A stage is a function of (spark, docs, sf_dir).  All but the last return the columns of
``documents``; what a stage returns is written as Parquet and read again for the next.

Defined cases: a document with a null, empty or letterless text has no language and goes in
the first stage.  Null ids, null languages and null sources are kept; null ids come first in
the token files.  Rows of the same id and text are one document after the second stage, and
then are taken as often as the mix says.  Very long texts are handled whole.  Other columns
are passed on up to the last stage.  Empty tables give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from catalens.llm import decontamination, language_id, mixing, simhash_dedup, token_output
from catalens.llm.queries import WORD_VOCABULARY
from catalens.llm.shared import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language.  The model learns from the labelled ones among them."""
    return language_id.accepted(docs, language_id.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link within op6's shingles and radius."""
    return simhash_dedup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in binary shards; a row per document, read back from them."""
    return token_output.encode_corpus(docs, public_tokenizers.path(WORD_VOCABULARY))


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("source_mix", mixture),
    ("token_files", tokens),
]

#: Learned models, hashing of shingles and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
