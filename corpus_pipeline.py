"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``. Null, empty and very long texts, ties, repeated rows and empty tables are
treated as the operators' docstrings say; a document without a letter goes in the first stage. Other columns
stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import langid, minhash, packing, pii, suffix
from trafficlens.llm.common import free_names, read
from trafficlens.session import materialize

#: Posterior probability that a document's language needs.
MIN_SCORE = 0.5
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or with an unsure language go."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    found = langid.predicted(rows, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (five words, similarity 0.8); rows that repeat it stay as they are."""
    (own,) = free_names(docs, "kept_id")
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what is repeated from earlier ones; documents of which nothing is left go."""
    found = suffix.cut_rows(docs, as_text=True)
    left = found.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("n_removed") > 0
    text = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")),
            "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return left.select(*(text.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms masked; all documents stay."""
    found = pii.masked(pii.sanitised(docs))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.packed_sequences(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Suffix arrays, signatures and a public tokenizer's ids can't be told in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
