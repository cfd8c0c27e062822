"""Registered queries of the subpackage, one per operator, and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, extraction, jaccard, langid, lines, media, packing, quality, suffix
from .chat import format_chat, read_back
from .common import table

PROBE = "</s>[INST] ok [/INST]"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the output."""
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    read = read_back(format_chat(turns.union(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "end_state",
        "valid",
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.PATTERN)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as JPEG; every figure comes from the stored bytes."""
    return media.features(media.store(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents lose of their repeated 100-byte strings."""
    return suffix.removed(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten or more sources share."""
    return lines.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "text", "n_lines", "n_removed")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document under links of near equality."""
    return jaccard.join(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict for all documents, with their source as host."""
    return quality.quality(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extraction.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' pieces, packed into sequences of at most 2048 tokens."""
    return packing.pack(packing.tokenized(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_media_columns": op3_media_columns,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE = {
    "op1_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    length(replace(role, '\', '\0')) + length(replace(text, '\', '\0')) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))
      + 2 * len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>'))
      + 2 * len(regexp_extract_all(role, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>'))
      + (length(role) - length(replace(role, chr(10), ''))) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  CASE WHEN bool_and(coalesce(before, 'start') || '|' || role IN ('start|system', 'start|user', 'system|user', 'user|assistant', 'assistant|user', 'assistant|tool', 'tool|assistant'))
    THEN arg_max(role, k) ELSE 'error' END AS end_state,
  bool_and(coalesce(before, 'start') || '|' || role IN ('start|system', 'start|user', 'system|user', 'user|assistant', 'assistant|user', 'assistant|tool', 'tool|assistant')) AND arg_max(role, k) = 'assistant' AS valid
FROM marked GROUP BY conv_id""",
    "op5_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
normal AS (SELECT *, trim(lower(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')), ' ') AS n FROM lines),
shared AS (SELECT n, min(doc_id) AS keeper FROM normal WHERE n <> '' GROUP BY n HAVING count(DISTINCT source) >= 10),
marked AS (SELECT normal.*, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM normal LEFT JOIN shared USING (n))
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') END AS text,
  count(line) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM documents d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id, d.text""",
}
