"""The corpus pipeline: stages over the documents table, each written and reread as the next one's input.

1. language: texts without a letter, and texts of which too few n-grams are known in any language,
   go. The filter is learned from the stage's own rows that have a language.
2. near_duplicates: of each group of near copies (five-word shingles, similarity 0.8 or more) the
   document with the smallest doc_id stays. A doc_id is one document: all its rows stay or go. Rows
   without a doc_id stay.
3. decontamination: documents that hold an item of ``benchmark`` go.
4. personal_data: items found in the texts are masked; n_chars follows the text.
5. mixing: every row gets its place in the mix of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.llm.common import dropped, table, written
from rallyframe.llm.decontaminate import without_leaks
from rallyframe.llm.langid import fit_languages, identified
from rallyframe.llm.mixing import mix_sources
from rallyframe.llm.neardup import near_duplicates
from rallyframe.llm.pii import mask_pii

ORACLE_SQL = None  # SQL can't express the stages; tests/llm/test_corpus_operators.py holds every stage against brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return identified(docs, fit_languages(docs))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_duplicates(docs, shingle=5, per_cent=80, rows=5, bands=30).where("NOT kept").select(F.col("doc_id").alias("__rf_id")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("__rf_id"), "leftanti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = mask_pii(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
