"""Shingle sets and their Jaccard similarity, compared exactly with 4/5.

Two sets of similarity 4/5 or more miss at most spare(n) = n - ceil(4n/5) of n shingles in one
another. So in any one order of all shingles, the first spare(n) + 1 of each set hold a common one.
The order is: shingles that are not frequent, by their hash; then frequent ones, by their hash.
Which shingles count as frequent is estimated from a sample of bounded size; any choice gives the
same pairs, and a good one keeps passages that many texts share out of most prefixes.

Defined results: A-Z is lower-cased; a text of fewer words than a shingle is one shingle; a null or
empty text is the empty set. Sets are told apart by a 64-bit code, so among 10^10 texts some two
different ones are expected to count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import cut, least_count

SEED = 42
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Texts that frequent shingles are estimated from, about; a sixteenth of the texts where that is less.
SAMPLE_TEXTS = 500_000
#: A shingle is frequent that stands in so many sampled texts.
FREQUENT = 4
#: The most frequent shingles that are broadcast.
FREQUENT_KEYS = 1_000_000
#: Texts of a shingle that meet in one task; the shards of more frequent ones are cut.
SHARD_TEXTS = 8192


def hashes(text: str | None, words: int) -> np.ndarray:
    """The 64-bit hashes of the word shingles, in order, repeats included."""
    found = (text or "").encode().translate(_FOLD).split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    k = min(words, len(found))
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)), dtype=np.uint64, count=len(found) - k + 1)


def spare(n: int) -> int:
    """How many of n shingles a near copy may lack."""
    return n - (4 * n + 4) // 5


def code_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


@dataclass(frozen=True)
class Frequent:
    """Frequent shingles, sorted, and into how many parts the shard of each is cut."""

    shingles: np.ndarray
    parts: np.ndarray

    def place(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some shingles are frequent, and the parts of their shards."""
        if not len(self.shingles):
            return np.zeros(len(shingles), dtype=bool), np.ones(len(shingles), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        known = self.shingles[at] == shingles
        return known, np.where(known, self.parts[at], 1)


def frequent(docs: DataFrame, words: int, shard_texts: int = SHARD_TEXTS) -> Frequent:
    """The shingles that stand in many texts, from a sample."""
    share = max(16, docs.count() // SAMPLE_TEXTS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes(text.as_py(), words)).view(np.int64))], ["x"])

    text = F.col("text").cast("string")
    sample = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).distinct()
    counted = cut(sample.mapInArrow(each, "x long").groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT))
    top = counted.where(F.col("n") >= least_count(counted, FREQUENT_KEYS)).toArrow()
    x, n = top["x"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(x)
    return Frequent(x[order], 1 + n[order] * share // shard_texts)


def prefix(shingles: np.ndarray, known: Frequent) -> tuple[np.ndarray, np.ndarray, int]:
    """The first shingles of a set in the common order, the parts of their shards, and the share of frequent ones in thousandths."""
    often, parts = known.place(shingles)
    order = np.argsort(often, kind="stable")[: spare(len(shingles)) + 1]
    return shingles[order], parts[order], int(often.sum()) * 1000 // max(1, len(shingles))


def sets(rows: DataFrame, words: int) -> DataFrame:
    """code and shingles of each row's text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(hashes(x.as_py(), words)) for x in batch.column("text")]
            code = np.array([code_of(x) for x in found], dtype=np.uint64)
            ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, dtype=np.uint64), *found]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["code", "shingles"])

    return rows.select(F.col("text").cast("string").alias("text")).mapInArrow(made, "code long, shingles array<long>")


#: Bits of a set's parity map and of its SimHash; both as words of 64.
MAP_BITS = 128
#: SimHashes of two sets of 4/5 are acos(8/9)/pi of their bits apart, 19 +- 4; more than so many with a probability below 1e-9.
FAR_BITS = 48
#: Shingles from which a SimHash is as good as its normal limit. (Parity maps tell smaller sets apart.)
HASHED = 128


def signatures(shingles: np.ndarray) -> np.ndarray:
    """Two words of a set's parity map, and two of its SimHash (each shingle once)."""
    parity = np.packbits((np.bincount((shingles >> np.uint64(7)).astype(np.int64) % MAP_BITS, minlength=MAP_BITS) & 1).astype(np.uint8)).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = shingles * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    counts = np.zeros(128, dtype=np.int64)
    for at in range(0, len(shingles), 8192):
        part = slice(at, at + 8192)
        counts[:64] += np.unpackbits(shingles[part].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        counts[64:] += np.unpackbits(mixed[part].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.concatenate((parity, np.packbits(2 * counts > len(shingles)).view(np.uint64)))


def may_be_alike(signed: tuple[np.ndarray, ...], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets at places a and b can have a similarity of 4/5: by size and parity map for certain, large ones also by SimHash.

    A shingle that only one of two sets has changes one bit of a parity map, so maps differ in no more bits than sets in shingles.
    """
    x, y = n[a], n[b]
    apart = lambda i: np.bitwise_count((signed[i][a] ^ signed[i][b]).view(np.uint64)).astype(np.int64)
    found = (5 * np.minimum(x, y) >= 4 * np.maximum(x, y)) & (9 * (apart(0) + apart(1)) <= x + y)
    return found & ((np.minimum(x, y) < HASHED) | (apart(2) + apart(3) <= FAR_BITS))


def alike(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, sa, sb) of a similarity of 4/5 or more, as (a, b)."""
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(common * 9 >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")
