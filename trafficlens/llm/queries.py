"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import ann, bpe, chat, langid, minhash, mixing, packing, pii, quality, resample, secrets, suffix, vantage
from trafficlens.llm.common import read

PACK_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def substring_digest(docs: DataFrame) -> DataFrame:
    return suffix.without_repeats(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(read(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=2, threshold=0.8)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(read(spark, sf_dir, "documents"), PACK_TOKENIZER)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(read(spark, sf_dir, "documents"), MULTI_RANKS)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_turns(chat.with_probe(read(spark, sf_dir, "conversations"))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitised(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(read(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.digest(*vantage.clustered(read(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_chat_format": op5_chat_format,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_pii": op8_pii,
    "op9_language": op9_language,
    "op10_neighbours": op10_neighbours,
    "op11_mixing": op11_mixing,
    "op12_resampling": op12_resampling,
    "op13_clustering": op13_clustering,
}

ORACLES: dict[str, str] = {"op6_quality": quality.ORACLE, "op11_mixing": mixing.ORACLE, "op12_resampling": resample.ORACLE}
