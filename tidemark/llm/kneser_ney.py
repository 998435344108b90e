"""Quality by perplexity: an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted rows are those that the labels call good and not toxic. The model counts every token of every
trusted document of one half, fixed by a hash of its id; the other half sets the thresholds. The log probability
of a token is a sum of terms of its trigram, its bigrams and its words, each of which is zero unless the model
has met the n-gram. A small model is one table of keys and terms, which is broadcast. A larger one is three tables of counts
in parts (ngrams.py), which chunks of documents ask for the distinct n-grams that they hold; no count is left out, and
what counts say of probabilities is worked out where the documents are. A document is kept
unless its perplexity, or that of its worst window of two blocks of BLOCK tokens, passes a high
quantile of the same figure over the trusted documents of its language that the model has not seen.

Defined results: a null or empty text has only the end token; a null lang is a language of its own;
a language without trusted rows has no threshold and keeps everything; repeated rows are scored one
by one; a text at its threshold is kept; a text of any length is scored whole, one row a block after
Spark's partial sums; other columns are ignored; an empty table gives an empty result, and with no trusted row all
tokens are equally unlikely and everything is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import cut
from tidemark.llm.ngrams import LENGTHS, Chunk, Chunks, Group, Tables, occurrences, questions, table
from tidemark.llm.text import lower_ascii, space_words, whole_text

#: Rows of a table that are broadcast, and ids.
HOT_ROWS, BROADCAST_IDS = 3_000_000, 10_000_000
QUANTILE = 0.99
#: Tokens of half a window.
BLOCK = 16
#: Words the unknown share of the unigram level is spread over.
UNSEEN = 1_000_000


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, h (hashes of two starts, the words and the end) and p (those of each and the next): a bigram hash serves two steps."""
    padded = docs.select(*keep, F.concat(F.array(F.lit(1), F.lit(1)).cast("array<bigint>"), F.transform(space_words(lower_ascii(whole_text(F.col("text")))), lambda w: F.xxhash64(w)), F.array(F.lit(2)).cast("array<bigint>")).alias("h"))
    return padded.select(*keep, "h", F.expr("transform(h, (x, i) -> xxhash64(x, get(h, i + 1)))").alias("p"))


def tokens(docs: DataFrame) -> DataFrame:
    """A row a token: hashes w, v and uv of the token, the word before it and the two words before it."""
    return _hashed(docs).select(F.inline(F.expr("transform(slice(h, 3, size(h) - 2), (x, i) -> named_struct('w', x, 'v', h[i + 1], 'uv', p[i]))")))


def grams(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, and a row a token and one for the start: its place (the start's is -1), and hashes w, vw, uvw of what ends there."""
    return _hashed(docs, *keep).select(*keep, F.inline(F.expr("transform(slice(h, 2, size(h) - 1), (x, i) -> named_struct('at', i - 1, 'w', x, 'vw', p[i], 'uvw', xxhash64(get(p, i - 1), x)))")))


def _discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ of how many counts are 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found, strict=True)]


def _counts(counts: DataFrame) -> list[int]:
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    return [row[f"n{k}"] for k in (1, 2, 3, 4)]


def _discount(d: list[float]) -> Column:
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


@dataclass(frozen=True)
class Model:
    #: (key, p): the term of each n-gram of a small model; as a context an n-gram has the key with all bits turned over. Else empty.
    hot: DataFrame
    #: (key, context, n) of a larger model, as rows for those who want to see them: key is the n-gram's number, n its count or its occurrences as a context.
    cold: DataFrame | None
    #: log10 of the probability of a token of which nothing is known.
    unknown: float
    #: The larger model itself, the discounts of words, bigrams and trigrams, and the sum of the counts of words.
    tables: Tables | None = None
    discounts: tuple[list[float], ...] = ()
    whole: int = 0


def fit(texts: DataFrame, hot_rows: int = HOT_ROWS) -> Model:
    """The model of all tokens of the texts: small enough to be broadcast if it is sure to have no more than hot_rows terms, else in parts."""
    # A word takes two bytes with the space after it, and a token adds five terms at most.
    size = texts.agg(F.coalesce(F.sum(F.octet_length(whole_text(F.col("text"))) / 2 + 2), F.lit(0.0))).first()[0]
    return _fit_small(texts) if 5 * size <= hot_rows else _fit_in_parts(texts)


def _fit_small(texts: DataFrame) -> Model:
    c3 = cut(tokens(texts).groupBy("uv", "v", "w").agg(F.count("*").alias("n")))
    # n: different words before.
    c2 = cut(c3.groupBy("v", "w").agg(F.count("*").alias("n")))
    c1 = cut(c2.groupBy("w").agg(F.count("*").alias("n")))
    d3, d2, d1 = (_discount(_discounts(_counts(c))) for c in (c3, c2, c1))
    contexts = lambda counts, key, d: counts.groupBy(key).agg(F.sum("n").alias("whole"), F.sum(d).alias("off")).select(key, "whole", (F.col("off") / F.col("whole")).alias("left"))

    whole, off = c1.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(d1), F.lit(0.0))).first()
    unknown = (off / whole if whole else 1.0) / UNSEEN
    # What a level adds to what the shorter n-grams give: log10 of a probability over the share that is left to them.
    p1 = c1.select("w", (((F.col("n") - d1) / whole if whole else F.lit(0.0)) + unknown).alias("p1"))
    l2 = cut(contexts(c2, "v", d2))
    p2 = cut(c2.join(l2, "v").join(p1, "w").select("v", "w", (F.col("left") * F.col("p1")).alias("less"), ((F.col("n") - d2) / F.col("whole")).alias("own")))
    l3 = contexts(c3, "uv", d3)
    p3 = c3.join(l3, "uv").join(p2.select("v", "w", (F.col("own") + F.col("less")).alias("p2")), ["v", "w"]).select("uv", "w", (F.col("left") * F.col("p2")).alias("less"), ((F.col("n") - d3) / F.col("whole")).alias("own"))
    gain = F.log10((F.col("own") + F.col("less")) / F.col("less"))
    levels = [
        p1.select(F.col("w").alias("key"), F.log10(F.col("p1") / unknown).alias("p")),
        p2.select(F.xxhash64("v", "w").alias("key"), gain.alias("p")),
        p3.select(F.xxhash64("uv", "w").alias("key"), gain.alias("p")),
        l2.select(F.bitwise_not("v").alias("key"), F.log10("left").alias("p")),
        l3.select(F.bitwise_not("uv").alias("key"), F.log10("left").alias("p")),
    ]
    terms = levels[0]
    for level in levels[1:]:
        terms = terms.unionByName(level)
    return Model(cut(terms), None, math.log10(unknown))


def _fit_in_parts(texts: DataFrame) -> Model:
    spark = texts.sparkSession
    tables = Tables(Chunks(texts))

    def counts(sent: Iterator) -> Iterator[np.ndarray]:
        n = table(list(sent))[1][0]
        yield np.array([*[(n == k).sum() for k in (1, 2, 3, 4)], (n >= 3).sum(), n.sum()], dtype=np.int64)

    found = [[int(x) for x in level.mapPartitions(counts).reduce(lambda a, b: a + b)] for level in tables.levels]
    discounts = tuple(_discounts(n[:4]) for n in found)
    once, twice, _, _, more, whole = found[0]
    unknown = (sum(d * n for d, n in zip(discounts[0], (once, twice, more), strict=True)) / whole if whole else 1.0) / UNSEEN

    parts = tables.parts

    def rows(part: int, sent: Iterator, level: int) -> Iterator[tuple]:
        _, values, _ = table(list(sent))
        for context, n in zip((False, True), (values[0], occurrences(*values[1:])) if len(values) > 1 else values, strict=False):
            for rank in np.flatnonzero(n):
                yield (int(rank) * parts + part) * 4 + level, context, int(n[rank])

    terms = spark.sparkContext.union([x.mapPartitionsWithIndex(partial(rows, level=i)) for i, x in enumerate(tables.levels)])
    schema = "key long, context boolean, n long"
    return Model(spark.createDataFrame([], "key long, p double"), spark.createDataFrame(terms, schema, verifySchema=False), math.log10(unknown), tables, discounts, whole)


#: The terms that what ends at a place may have: of the token there, and, as contexts, of the next one.
_OWN, _NEXT = ("w", "vw", "uvw"), ("w", "vw")


def _met(rows: DataFrame, hot: DataFrame, *keep: str) -> DataFrame:
    """rows with the value of each hot term: own_ of the token, next_ of the one after it; null if it is not hot."""
    keyed = rows.select(*keep, "at", *_OWN, *[F.bitwise_not(c).alias(f"c_{c}") for c in _NEXT])
    for key, value in [*((c, f"own_{c}") for c in _OWN), *((f"c_{c}", f"next_{c}") for c in _NEXT)]:
        keyed = keyed.join(F.broadcast(hot.select(F.col("key").alias(key), F.col("p").alias(value))), key, "left")
    return keyed


def _block(at: Column | str) -> Column:
    """The block of a place; the start is counted to the first."""
    return F.floor(F.greatest(at, F.lit(0)) / BLOCK)


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """keep, n_tokens, log10_prob and worst (the greatest perplexity of two blocks in a row) of every row.

    By a model in parts, docs are read several times, and have to be in the same partitions and order each time, as files are.
    """
    return _score_by_broadcast(docs, model, *keep) if model.tables is None else _score_by_parts(docs, model, *keep)


def _score_by_broadcast(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    met = _met(grams(docs.withColumn("__row", F.monotonically_increasing_id()), "__row", *keep), model.hot, "__row", *keep)
    total = lambda kind, cs: sum((F.coalesce(f"{kind}_{c}", F.lit(0.0)) for c in cs), F.lit(0.0))
    part = lambda block, n, p: F.struct(block.alias("block"), n.cast("long").alias("n"), p.alias("p"))
    here, after = _block("at"), _block(F.col("at") + 1)
    is_token = (F.col("at") >= 0).cast("long")
    of_own, of_next = total("own", _OWN) + is_token * model.unknown, total("next", _NEXT)
    parts = F.when(here == after, F.array(part(here, is_token, of_own + of_next))).otherwise(F.array(part(here, is_token, of_own), part(after, F.lit(0), of_next)))
    # What would come after the end is in no block.
    blocks = met.select("__row", *keep, F.inline(parts)).groupBy("__row", *keep, "block").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where("n > 0")
    whole = blocks.groupBy("__row", *keep).agg(F.sum("n").alias("n_tokens"), F.sum("p").alias("log10_prob"), F.sort_array(F.collect_list(F.struct("block", "n", "p"))).alias("b"))
    # A text of one block is a window of its own.
    worst = F.expr("array_max(transform(slice(b, 1, greatest(size(b) - 1, 1)), (x, i) -> pow(10D, -(x.p + coalesce(get(b, i + 1).p, 0D)) / (x.n + coalesce(get(b, i + 1).n, 0L)))))")
    return whole.select(*keep, "n_tokens", "log10_prob", worst.alias("worst"))


def _score_by_parts(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    chunks, answers = Chunks(docs, keep), []
    for level in range(LENGTHS):
        asked = chunks.each(model.tables.parts, list(answers), questions)
        answers.append(model.tables.answers(level, asked, chunks.parts))
    rows = chunks.each(model.tables.parts, answers, partial(_scores, discounts=model.discounts, whole=model.whole, unknown=10.0**model.unknown))
    schema = docs.select(*keep).schema
    for name, kind in (("n_tokens", "long"), ("log10_prob", "double"), ("worst", "double")):
        schema = schema.add(name, kind)
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def _scores(_p: int, _i: int, group: Group, discounts: tuple[list[float], ...], whole: int, unknown: float) -> Iterator[tuple]:
    """Rows of score() of the texts of a group."""
    # Of each n-gram: what is its own of the occurrences, and as a context one over these and the share that is left to shorter ones.
    own, one, left = [], [], []
    for level, values in enumerate(group.values):
        n = values[0]
        n -= np.array([0.0, *discounts[level]])[np.minimum(n, 3).astype(np.uint8)]
        own.append(n)
        if level + 1 < LENGTHS:
            held, d = occurrences(*values[1:]), discounts[level + 1]
            one.append(np.divide(1.0, held, out=np.zeros_like(held), where=held > 0))
            left.append(np.where(held > 0, (d[0] * values[1] + d[1] * values[2] + d[2] * values[3]) * one[-1], 1.0))
    group.values.clear()
    for chunk in group.chunks:
        p = own[0][chunk.places[0]] / max(whole, 1) + unknown
        for level in range(1, LENGTHS):
            before = chunk.places[level - 1][:-1]
            p[1:] = own[level][chunk.places[level][1:]] * one[level - 1][before] + left[level - 1][before] * p[1:]
        yield from _rows(chunk, p)


def _rows(chunk: Chunk, p: np.ndarray) -> Iterator[tuple]:
    """Rows of score() of the texts of a chunk, of the probability of what stands at each place."""
    real = np.ones(len(p), dtype=bool)
    real[chunk.begins] = real[chunk.begins + 1] = False
    logs, sizes = np.log10(p[real]), chunk.counts + 1
    begins = np.cumsum(sizes) - sizes
    # Blocks of texts, and windows of two.
    blocks = -(-sizes // BLOCK)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(begins - BLOCK * first, blocks) + BLOCK * np.arange(blocks.sum())
    sums, n = np.add.reduceat(logs, starts), np.diff(starts, append=len(logs))
    last = np.zeros(len(starts), dtype=bool)
    last[first + blocks - 1] = True
    more = np.where(last, 0, np.concatenate([sums[1:], [0]])), np.where(last, 0, np.concatenate([n[1:], [0]]))
    windows = np.where(last & np.repeat(blocks > 1, blocks), -np.inf, -(sums + more[0]) / (n + more[1]))
    worst = 10.0 ** np.maximum.reduceat(windows, first)
    for row, *scores in zip(chunk.rows, sizes.tolist(), np.add.reduceat(logs, begins).tolist(), worst.tolist(), strict=True):
        yield (*row, *scores)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_tokens, log10_prob, perplexity, threshold, worst, worst_threshold and kept of every row."""
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").where("doc_id is not null").distinct()
    # So that no text goes by shuffle to meet its label.
    near = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    # Half of the ids, whatever the size: thresholds are to come from texts that the model has not seen.
    learned = lambda doc_id: F.pmod(F.xxhash64(doc_id), F.lit(1_000_003)) < 0.5 * 1_000_003
    model = fit(docs.where(learned(F.col("doc_id"))).select("doc_id", "text").join(near, "doc_id", "left_semi").select("text"))
    scored = cut(score(docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang_key"), "text"), model, "doc_id", "lang_key"))
    perplexity = F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))
    unseen = scored.where(~learned(F.col("doc_id"))).join(near, "doc_id", "left_semi").withColumn("perplexity", perplexity)
    # One row a language; joined by shuffle, the rows of a common language would meet in one task.
    limits = cut(unseen.groupBy("lang_key").agg(*[F.percentile_approx(c, QUANTILE, 10_000).alias(t) for c, t in (("perplexity", "threshold"), ("worst", "worst_threshold"))]))
    out = scored.withColumn("perplexity", perplexity).join(F.broadcast(limits) if limits.count() <= HOT_ROWS else limits, "lang_key", "left")
    kept = F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")) & (F.col("worst") <= F.col("worst_threshold"))
    return out.select("doc_id", F.col("lang_key").alias("lang"), "n_tokens", "log10_prob", "perplexity", "threshold", "worst", "worst_threshold", kept.alias("kept"))
