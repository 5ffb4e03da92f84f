"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of documents. The learned and iterated stages
(language identification, near-duplicates, decontamination) have no SQL, so the whole has none.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from selfsim.llm import decontaminate, languageid, pii, sentencepiece_fst, simhash
from selfsim.llm.common import remove, scratch

TOKENIZER = os.environ.get("PIPELINE_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
#: Of the pseudonyms. The one that stands here is published, for measurements; a production run sets its own.
PII_KEY = os.environ.get("PII_KEY", "published key for measurements").encode()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, null and empty texts among them, and those whose score is hardly better than chance
    (languageid.MARGIN of the way from chance to certainty). Without any labelled document none goes."""
    return languageid.reject(docs, languageid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays, that with the smallest id, a null id last; a repeated row once."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy or a paraphrase of a benchmark item go, each by its own text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values and secrets are replaced in the texts; every row stays."""
    return pii.pseudonyms(docs, PII_KEY).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of every document that is left; a null text has no tokens."""
    with open(TOKENIZER, "rb") as f:
        return sentencepiece_fst.encode(docs, f.read())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", pseudonymise),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder as Parquet and read again by the next; a stage's table goes when the next one's is written, the last when the application ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        there = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(there)
        docs = spark.read.parquet(there)
        if before:
            remove(spark, before)
        before = there
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
