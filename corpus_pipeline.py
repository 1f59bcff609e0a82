"""A corpus pipeline over `documents`: language ID, exact dedup, near dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs.  All but the last return the columns of `documents`.  Nulls, empty and very long texts, ties, repeated
rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaitwork.llm import exact_dedup, jvm, language_id, near_copies, packing, pii
from plaitwork.llm.common import documents, fresh, written

VOCABULARY = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language go on as they are; those that have none (null texts, texts without a letter) go."""
    jvm.local_files(spark)  # for this stage's files and those of the ones after it
    name = fresh(docs, "predicted")
    predicted = language_id.predicted_column(docs, language_id.fit(docs), name)
    return predicted.where(F.col(name) != language_id.UNKNOWN).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest, then the one with the least id, stays."""
    jvm.local_files(spark)
    return exact_dedup.deduplicated(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by op7's fingerprints or by 0.8 of their five-word shingles, the one with the least id stays."""
    jvm.local_files(spark)
    name = fresh(docs, "stay")
    groups = near_copies.near_duplicates(docs, fingerprints=True)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi").select(*docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text."""
    jvm.local_files(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else clean.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences of 2048."""
    jvm.local_files(spark)
    return packing.packed(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("pii", redact_pii),
    ("packing", pack),
]

#: SQL can't express language ID, SimHash or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
