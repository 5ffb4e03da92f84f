"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selfsim.llm import chat, decontaminate, languageid, licenses, pii, quality, sentencepiece_fst, sharding, simhash, urls
from selfsim.llm.common import scratch, table

#: The folder of public tokenizer files.
TOKENIZERS = os.environ.get("TOKENIZERS", "/opt/tokenizers")


#: Of the pseudonyms; published, for measurements, where PII_KEY is unset.
PII_KEY = os.environ.get("PII_KEY", "published key for measurements").encode()


def model_file(folder: str = TOKENIZERS, name: str = "piece_bpe_32k.model") -> bytes:
    with open(f"{folder}/{name}", "rb") as f:
        return f.read()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("cleaned")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(table(spark, sf_dir, "documents"), model_file())


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "pii_count", "pii_kinds")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = languageid.predict(docs, languageid.fit(docs))
    return out.select("doc_id", languageid.held_out().alias("held_out"), "lang_pred", "score", "labelled_positions")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arrivals of documents (by a hash of the id), one compaction, and the rows of the version that it committed."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.Store(spark, scratch(spark, "shards"))
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for k in range(3):
        store.append(docs.where(arrival == k))
    store.compact()
    # the query is the store's only writer and reader
    store.vacuum(retention=0)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ALL = (op1_quality_rules, op2_license_scans, op3_sentencepiece, op4_pii, op5_chat_formatting, op6_simhash, op7_language_id, op8_sharding, op9_url_filters, op10_decontamination)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.SQL,
        "op2_license_scans": licenses.SQL,
        "op5_chat_formatting": chat.SQL,
        "op8_sharding": 'SELECT doc_id, lang, source, n_chars, sha256("text") AS text_sha256 FROM documents',
        "op9_url_filters": urls.SQL,
    }
