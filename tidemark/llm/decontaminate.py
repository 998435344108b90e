"""Benchmark decontamination: a prefix-filtered set join of item windows with texts, natively.

A window (SIZE consecutive words of an item, or the whole of a shorter item) occurs in a text when
all its words stand there in a row, so all its shingles (pairs of neighbouring words) must be there.
With full containment the necessary prefix of a window, in order of rarity, is its one rarest
shingle. How often each shingle of the benchmark stands in the texts is counted over all texts; a
window with a shingle that never does is dropped. Then all shingles of all texts are joined to the
rarest ones. The shingle's place in the window gives where the window would start; starts before
the text or ends beyond it are dropped (positional and length bounds). What is left is verified in
the same pass: the window's words are compared with the words of the text.

The benchmark side is broadcast if it has at most BROADCAST_ROWS rows, which is checked; beyond
that Spark joins by shuffle.

Defined results: a null or empty text has no words, a null or empty item no window; a null item_id
is left out; repeated rows each get a row; of shingles that are equally rare the first in the window
is taken; a text of any length is shingled whole; other columns are ignored; an empty benchmark
leaves all texts clean; an empty table of texts gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import cut
from tidemark.llm.text import letter_words, row_key, whole_text

SIZE = 10
BROADCAST_ROWS = 500_000

_GRAMS = "if(size(w) < 2, transform(w, x -> xxhash64(x)), transform(slice(w, 1, size(w) - 1), (x, i) -> xxhash64(x, w[i + 1])))"


def windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(item, words) of every window, repeats included."""
    words = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), letter_words(whole_text(F.col("text"))).alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(1, greatest(size(w) - {size - 1}, 1))")
    return words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("w"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingled(texts: DataFrame, single: bool) -> DataFrame:
    """(row, k0, k1, doc_id, n_words, w, p, gram), at least one row a text. single: one-word windows exist, so words are shingles too."""
    words = texts.select(F.monotonically_increasing_id().alias("row"), "k0", "k1", "doc_id", letter_words(F.col("text")).alias("w"))
    own = ["row", "k0", "k1", "doc_id", F.size("w").cast("long").alias("n_words"), "w"]
    names = ["row", "k0", "k1", "doc_id", "n_words", "w"]
    # Arrays are made one step before they are exploded, so that Spark compiles the step that has a row a shingle.
    rows = words.select(*own, F.expr(_GRAMS).alias("grams")).select(*names, F.posexplode_outer("grams").alias("p", "gram"))
    if single:
        each = words.where("size(w) > 1").select(*own, F.transform("w", lambda x: F.xxhash64(x)).alias("grams"))
        rows = rows.unionByName(each.select(*names, F.posexplode("grams").alias("p", "gram")))
    return rows


def occurrences(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Documents (k0, k1, doc_id, n_words, found: sorted (start, size, window) of verified windows), and (window, item)."""
    cutting = cut(windows(benchmark, size).select("item", F.array_join("w", " ").alias("window"), "w"))
    items = cutting.select("window", "item").distinct()
    each = cut(cutting.dropDuplicates(["window"]).select("window", F.size("w").alias("size"), F.posexplode(F.expr(_GRAMS)).alias("place", "gram")))
    single = bool(each.where("size = 1").limit(1).count())
    texts = row_key(docs)

    # Rarity: each benchmark shingle's occurrences over all texts.
    shingles = _shingled(texts, single)
    counted = shingles.join(_small(each.select("gram").distinct()), "gram").groupBy("gram").agg(F.count("*").alias("often"))
    ranked = each.join(counted, "gram", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    prefix = cut(ranked.groupBy("window", "size").agg(F.min(F.struct("often", "place", "gram")).alias("rarest")).where("rarest.often > 0").select("window", "size", F.col("rarest.place").alias("place"), F.col("rarest.gram").alias("gram")))

    start = F.col("p") - F.col("place")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n_words"))
    # Verified where the words are at hand; texts are not read again for it.
    stands = F.coalesce(F.when(fits, F.expr("array_join(slice(w, p - place + 1, size), ' ') = window")), F.lit(False))
    matched = shingles.join(_small(prefix), "gram", "left").where((F.coalesce("p", F.lit(0)) == 0) | stands)
    # One row a text: n_words is the text's, so the grouping has a row for each text, and the set is bounded by its length.
    by_text = matched.withColumn("held", F.when(stands, F.struct(start.alias("start"), "size", "window"))).groupBy("row", "k0", "k1", "doc_id", "n_words").agg(F.collect_set("held").alias("held"))
    return by_text.select("k0", "k1", "doc_id", "n_words", F.when(F.size("held") > 0, F.sort_array("held")).alias("found")), items


#: Words covered by sorted intervals (start, size).
_COVERED = """aggregate(found, struct(0 AS done, 0L AS n),
    (a, c) -> struct(greatest(a.done, c.start + c.size) AS done, a.n + greatest(c.start + c.size - greatest(a.done, c.start), 0) AS n), a -> a.n)"""


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as strings) and contaminated, one row a document."""
    found, items = occurrences(docs, benchmark, size)
    found = cut(found)
    hit = found.where("found is not null").select("k0", "k1", F.explode(F.array_distinct("found.window")).alias("window"))
    named = hit.join(items, "window").groupBy("k0", "k1").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.coalesce(F.expr(_COVERED), F.lit(0)).cast("long")
    out = found.select("k0", "k1", "doc_id", "n_words", n_hit.alias("n_hit")).join(named, ["k0", "k1"], "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows that hold no window of an item, with all their columns."""
    found, _ = occurrences(docs, benchmark, size)
    dirty = found.where("found is not null").select("k0", "k1").distinct()
    own = [F.coalesce("doc_id", F.lit(-(2**63))) == dirty["k0"], F.xxhash64(whole_text(F.col("text"))) == dirty["k1"]]
    return docs.join(dirty, own, "left_anti")
