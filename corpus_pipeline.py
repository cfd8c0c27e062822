"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Language ID, line dedup, near-duplicate join, suffix-array dedup, packing. All stages but the last
return the columns of documents; where a stage changes text, n_chars follows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwright.llm import jaccard, langid, lines, packing, suffix
from bagwright.llm.common import discard, saved, scratch, table

#: A document goes if its language is undetermined or its score is lower than this.
LEAST_SCORE = 0.5


def _like(docs: DataFrame, made: DataFrame) -> DataFrame:
    """``made`` with the columns and types of ``docs``; n_chars counts the text again."""
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return made.withColumn("n_chars", n).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of LEAST_SCORE or more."""
    told = langid.predict(docs, langid.fit(docs.filter(~langid.held_out("doc_id"))), lang="_lang", value="_score")
    return told.filter((F.col("_lang") != langid.UNDETERMINED) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines."""
    return _like(docs, lines.dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.dedup(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings that start earlier."""
    return _like(docs, suffix.dedup(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return packing.pack(packing.tokenized(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", suffix_dedup),
    ("best_fit_packing", pack),
]
#: Naive Bayes, suffix order and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with scratch():  # what the stage made on its way goes, and then what it read
            docs = saved(stage(spark, before, sf_dir), "pipeline")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
