"""Text expressions shared by the operators: exact A-Z lower-casing and the two word definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ship import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: Everything that is not an ASCII digit, a lower-case ASCII letter or a non-ASCII character.
NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. lower() has a fast path for ASCII text, and does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _split(text: Column, separators: str) -> Column:
    def without_ends(parts: Column) -> Column:
        # A separator at either end leaves an empty string there.
        first = F.when(parts[0] == "", 2).otherwise(1)
        last = F.when(F.element_at(parts, -1) == "", F.size(parts) - 1).otherwise(F.size(parts))
        return F.when((first == 1) & (last == F.size(parts)), parts).otherwise(F.slice(parts, first, F.greatest(last - first + 1, F.lit(0))))

    # A lambda binds the split once; written out, each mention would split again.
    return F.transform(F.array(F.split(text, f"[{separators}]+")), without_ends)[0]


def space_words(text: Column) -> Column:
    """Maximal runs of characters that are not white space; none for an empty text."""
    return _split(text, SPACE)


def letter_words(text: Column) -> Column:
    """A-Z lower-cased, then maximal runs of ASCII letters, digits and non-ASCII characters."""
    return _split(lower_ascii(text), NOT_WORD)


def row_key(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a key (k0, k1) that repeated rows share and that is never null.

    Rows that repeat a doc_id with the same text are the same document twice and get the same
    result; rows that repeat a doc_id with another text stay apart.
    """
    text = whole_text(F.col("text"))
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("k0"), F.xxhash64(text).alias("k1"))
