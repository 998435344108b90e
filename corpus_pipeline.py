"""Corpus cleaning: five stages, each applied to all that the one before it kept.

Each stage takes a table with doc_id and text (and lang, if there is one to learn from) and any other
columns, whatever their names. All but the last return its columns. In every stage an empty table
gives an empty one, and a text of any length is read whole, in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, langid, pii, sentencepiece, simhash
from tidemark.llm.components import cut
from tidemark.llm.ship import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go.

    Null and empty texts, and those without a letter, go. Rows of null lang teach nothing; without any
    lang all go. Repeated rows share their fate; of two languages at the same distance the first by name is taken.
    """
    ship(spark)
    return langid.keep_known(docs, langid.fit_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash candidates with a Jaccard similarity of five-word shingles of 0.8 or more.

    The one with the smallest doc_id stays, null ids last; of rows that repeat it the first. Null and
    empty texts and those without a word are copies of one another.
    """
    ship(spark)
    return simhash.keep_one(docs, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay; repeated rows share their fate."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars is counted again. Null texts stay null; each repeated row is masked alike."""
    masked = pii.mask(docs, pii.fit(docs))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of each text: null for a null text, none for an empty one; a row for each repeated row. Ties of paths go to the longest last piece."""
    ship(spark)
    return sentencepiece.encode(docs, sentencepiece.load())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]
#: The stages are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            # Each stage reads its input several times; stored, it is made once.
            docs = cut(docs)
    return docs
