"""Queries of this subpackage: op1 to op10 over whole tables, each through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from plaitwork.llm import bpe, chat, exact_dedup, flac, jvm, language_id, packing, pii, simhash, substring_dedup, token_store
from plaitwork.llm.common import documents, written

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_of(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    jvm.local_files(spark)  # for the files of blocks and for those that the session writes after them
    blocks = token_store.write_ids(documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY), end_id=0)
    return token_store.read_documents(blocks)


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(written(flac.encode_column(documents(spark, sf_dir)), "media", "zstd"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(chat.events_of(spark.read.parquet(f"{sf_dir}/conversations.parquet")), chat.RESPOND)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predictions(docs, language_id.fit(docs))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_bpe": op2_bpe, "op3_pii": op3_pii, "op4_packing": op4_packing, "op5_token_store": op5_token_store, "op6_flac": op6_flac, "op7_simhash": op7_simhash, "op8_exact_dedup": op8_exact_dedup, "op9_chat_format": op9_chat_format, "op10_language_id": op10_language_id}

ORACLES = {
    "op8_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)""",
    "op9_chat_format": r"""
        WITH n AS (
            SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN conv_id || ':' || turn END AS own,
                   last_value(CASE WHEN role = 'user' THEN conv_id || ':' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
            FROM conversations),
        k AS (
            SELECT *, CASE WHEN role = 'user' THEN 'call' WHEN role = 'assistant' AND last IS NOT NULL THEN 'result' ELSE 'message' END AS kind,
                   CASE WHEN role = 'user' THEN own WHEN role = 'assistant' THEN last END AS call_id FROM n),
        r AS (
            SELECT *, kind <> 'message' AND row_number() OVER (PARTITION BY conv_id, kind, call_id ORDER BY turn, text) > 1 AS repeated FROM k),
        m AS (
            SELECT r.*, NOT repeated AND kind <> 'message' AND EXISTS (SELECT 1 FROM r AS o WHERE o.conv_id = r.conv_id AND o.call_id = r.call_id AND o.kind <> r.kind AND o.kind <> 'message' AND NOT o.repeated) AS linked FROM r)
        SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS position, CAST(turn AS BIGINT) AS turn, kind, call_id, linked, repeated,
               CASE kind WHEN 'call' THEN text IS NOT NULL WHEN 'result' THEN linked ELSE text IS NOT NULL END AS valid, false AS cyclic,
               CASE kind
                 WHEN 'call' THEN '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || to_json(text) || ',' END || '"turn":' || turn || '},"id":"' || call_id || '","kind":"call","role":"user","tool":"respond"}'
                 ELSE '{' || CASE WHEN text IS NULL THEN '' ELSE '"content":' || to_json(text) || ',' END || CASE WHEN call_id IS NULL THEN '' ELSE '"id":"' || call_id || '",' END || '"kind":"' || kind || '","role":"' || role || '"}' END AS json
        FROM m""",
}
