"""Quality rules: a threshold table compiled into one projection of built-in functions.

Defined results: a null or empty text has no words and fails; repeated rows are judged one by one;
metrics that equal a bound hold; a text of any length is measured whole, with arrays of its words in
memory; columns other than doc_id and text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import SPACE, space_words, whole_text

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Very common function words of the four languages.
STOP_WORDS = (
    "the of and to in is that for it on was with as are be this by at or an from a "
    "der die das und ist von mit den zu ein eine nicht auf für im dem des "
    "le la les de des et un une en que qui pour est dans au du "
    "el los las y del se por con una su es para al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """low <= metric <= high; either bound may be missing."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        value = F.expr(self.metric)
        bounds = [value >= self.low] * (self.low is not None) + [value <= self.high] * (self.high is not None)
        test = bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]
        return F.coalesce(test, F.lit(True))


#: Metrics are SQL over the columns that measure() makes; a null metric (nothing to divide by) holds.
RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", None, 0.10),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", None, 0.50),
)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the metrics of every row, from built-in expressions only.

    Windows are compared by 64-bit hashes, made by doubling: hashes of 1, 2, 4 and 8 words.
    """
    assert WINDOW == 8  # three doublings
    blank = F.regexp_count("text", F.lit(f"[{SPACE}]"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    base = docs.select("doc_id", whole_text(F.col("text")).alias("text")).select(
        "doc_id",
        space_words(F.col("text")).alias("words"),
        (F.char_length("text") - blank).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
    )
    rest = ["word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words", "n_stop_words"]
    counted = base.select(
        "doc_id",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size("words").cast("bigint").alias("n_words"),
        F.size(F.filter("words", lambda w: w.isin(STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    for step in (1, 2, 4):
        counted = counted.select("doc_id", *rest, F.expr(f"transform(h, (x, i) -> xxhash64(x, get(h, i + {step})))").alias("h"))
    windows = counted.select("doc_id", *rest, F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))).alias("h"))
    # Only texts in which some window repeats go through the sort.
    again = windows.select("doc_id", *rest, F.expr("if(size(array_distinct(h)) < size(h), sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))), cast(array() AS array<struct<x: bigint, i: int>>))").alias("p"))
    starts = again.select("doc_id", *rest, F.expr("sort_array(transform(filter(p, (e, k) -> e.x <=> get(p, k - 1).x OR e.x <=> get(p, k + 1).x), e -> e.i))").alias("s"))
    covered = F.expr(f"aggregate(transform(s, (e, k) -> least({WINDOW}, coalesce(get(s, k + 1), e + {WINDOW}) - e)), 0L, (a, x) -> a + x)")
    return starts.select("doc_id", *rest, covered.alias("n_repeat_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """measure() with base_failed, the names of the rules that fail, and the verdict kept."""
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    measured = measure(docs).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return measured.withColumn("failed_rules", F.array_join(failed, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))
