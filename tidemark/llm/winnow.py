"""Document fingerprints by winnowing.

Every run of K characters has a rolling hash; of each window of WINDOW neighbouring ones the least is
chosen, of equal ones the rightmost, and a choice that several windows share is kept once, with
its position. Two texts that share a passage of K + WINDOW - 1 characters therefore share a chosen hash, and the
positions say where. A text of fewer runs than a window is one window; one shorter than K is one run.

A fingerprint is written hash@position, in order of positions, comma-joined. Two fingerprints are as like as
the share of distinct hashes that they have in common, 2 |a & b| / (|a| + |b|); two empty ones are alike.

neighbours() puts every document beside the one that follows it in descending doc_id in one exchange of
the texts: ranges of doc_id are cut at pivots from a sample of ids, and of each range the last document also
goes to the range that looks for it. Inside a range sorted rows stream by; a task holds two texts.

Defined results: a null text is empty and has an empty fingerprint; ids descend with nulls last, rows of one
id by the hash of their text; equal rows are neighbours of one another; a table of one row is its own
neighbour; texts of any length are hashed whole; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import whole_text

#: Characters of a run, and runs of a window: powers of two.
K, WINDOW = 16, 32
_BASE = 0x100000001B3
_WORD = 2**64 - 1
#: Characters that a task is to read, about, and sampled ids for each task.
TASK_CHARS, TASK_SAMPLE = 64_000_000, 32


@dataclass(frozen=True)
class Chosen:
    hashes: np.ndarray
    places: np.ndarray

    def written(self) -> str:
        return ",".join(f"{h:08x}@{p}" for h, p in zip(self.hashes.tolist(), self.places.tolist(), strict=True))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def rolling(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all runs of k; of all there is if that is less. Runs of twice the length come from two of half of it."""
    if not len(points):
        return np.zeros(0, dtype=np.uint32)
    with np.errstate(over="ignore"):
        if len(points) < k:
            value = np.uint64(len(points))
            for p in points:
                value = value * np.uint64(_BASE) + p
            found = np.array([value])
        else:
            found, power, length = points, np.uint64(_BASE), 1
            while length < k:
                found = found[:-length] * power + found[length:]
                power, length = power * power, 2 * length
        # Mixed, as the low bits of a polynomial tell little.
        found = found ^ (found >> np.uint64(31))
        found = found * np.uint64(0xBF58476D1CE4E5B9)
        found = found ^ (found >> np.uint64(29))
        return (found * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> Chosen:
    """The chosen hashes of a text, with their places."""
    hashes = rolling(code_points(text), k)
    n = len(hashes)
    if n <= 1:
        return Chosen(hashes, np.zeros(n, dtype=np.int64))
    if n < window:
        least = n - 1 - int(hashes[::-1].argmin())
        return Chosen(hashes[least : least + 1], np.array([least]))
    value, place, length = hashes, np.arange(n), 1
    while length < window:
        right = value[length:] <= value[:-length]
        place = np.where(right, place[length:], place[:-length])
        value = np.minimum(value[length:], value[:-length])
        length *= 2
    # Choices move to the right with their windows.
    new = np.concatenate(([True], place[1:] != place[:-1]))
    return Chosen(value[new], place[new])


def likeness(a: Chosen, b: Chosen) -> float:
    x, y = np.unique(a.hashes), np.unique(b.hashes)
    total = len(x) + len(y)
    return 2 * len(np.intersect1d(x, y, assume_unique=True)) / total if total else 1.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and chosen (hash, place) of every text, in order of places."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t or "") for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0] + [len(c.hashes) for c in found]).astype(np.int32)
            hashes, places = (np.concatenate([np.zeros(0, dtype=np.int64), *[getattr(c, f).astype(np.int64) for c in found]]) for f in ("hashes", "places"))
            entries = pa.StructArray.from_arrays([pa.array(hashes), pa.array(places)], ["hash", "place"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), entries)], ["doc_id", "chosen"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chosen array<struct<hash:bigint,place:bigint>>")


def shared_passages(docs: DataFrame, most_documents: int | None = None) -> DataFrame:
    """(hash, doc_id, place) of the chosen hashes that stand in two or more documents; most_documents leaves out more common ones."""
    each = fingerprints(docs).select("doc_id", F.explode("chosen").alias("x")).select("doc_id", "x.*")
    counted = each.select("hash", "doc_id").distinct().groupBy("hash").agg(F.count("*").alias("n"))
    common = counted.where(F.col("n") > 1 if most_documents is None else F.col("n").between(2, most_documents)).select("hash")
    return each.join(common, "hash")


def _key(text: Column) -> tuple[Column, Column, Column]:
    """Order of documents: whether there is an id, the id, the hash of the text."""
    return F.col("doc_id").isNotNull().alias("has_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("hash")


def _pivots(keys: DataFrame, n: int, chars: int) -> list[tuple]:
    """Keys that cut the order in ranges of about TASK_CHARS; at least as many as the session shuffles to, if there are enough rows."""
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // TASK_CHARS + 1)
    share = max(1, n // (parts * TASK_SAMPLE))
    rows = keys.where(F.pmod(F.xxhash64("id", "hash", F.lit(7)), F.lit(share)) == 0).distinct().collect()
    sample = sorted((r["has_id"], r["id"], r["hash"]) for r in rows)
    return [sample[i * len(sample) // parts] for i in range(1, parts)] if sample else []


def _range_of(pivots: list[tuple], has_id: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of pivots that are at most each key."""
    if not pivots:
        return np.zeros(len(ids), dtype=np.int64)
    at = [np.array([p[i] for p in pivots], dtype=t) for i, t in enumerate((bool, np.int64, np.int64))]
    both = [np.concatenate(x) for x in zip(at, (has_id, ids, hashes), strict=True)]
    kind = np.concatenate((np.zeros(len(pivots), dtype=np.int8), np.ones(len(ids), dtype=np.int8)))
    order = np.lexsort((kind, both[2], both[1], both[0]))
    below = np.empty(len(order), dtype=np.int64)
    below[order] = np.cumsum(kind[order] == 0)
    return below[len(pivots) :]


def neighbours(docs: DataFrame) -> DataFrame:
    """Rows for streaming: range, guest, has_id, id, hash, doc_id, text. In each range, in that order, the row before one is the document that follows it in descending doc_id.

    A guest only stands before its range's first row.
    """
    text = whole_text(F.col("text"))
    keys = docs.select(*_key(text), F.char_length(text).alias("chars"))
    n, chars = keys.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    pivots = _pivots(keys.drop("chars"), n, chars)

    @F.arrow_udf("long")
    def range_of(has_id: pa.Array, ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(_range_of(pivots, has_id.to_numpy(zero_copy_only=False), ids.to_numpy(), hashes.to_numpy()))

    key = ["has_id", "id", "hash"]
    placed = lambda rows: rows.withColumn("range", range_of(*key))
    # A row for each range.
    last = placed(keys.select(*key)).groupBy("range").agg(F.max(F.struct(*key)).alias("last")).orderBy("range").collect()
    follows = [(r["range"], *r["last"], last[(i + 1) % len(last)]["range"]) for i, r in enumerate(last)]
    guests = docs.sparkSession.createDataFrame(follows, "range long, has_id boolean, id long, hash long, host long")
    rows = placed(docs.select(*_key(text), "doc_id", text.alias("text"))).join(F.broadcast(guests), ["range", *key], "left")
    own = F.struct("range", F.lit(False).alias("guest"))
    stays = F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("range"), F.lit(True).alias("guest"))))
    spread = rows.withColumn("x", F.explode(stays)).select("x.range", "x.guest", *key, "doc_id", "text")
    return spread.repartition("range").sortWithinPartitions("range", F.desc("guest"), *key)


COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """text, its last half replaced by as much of another one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text (see edited()) and of the next document, descending doc_id."""
    rows = neighbours(docs).select("range", "guest", "doc_id", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, Chosen, str] | None = None
        for batch in batches:
            out: list[tuple] = []
            for guest, doc_id, text in zip(*(batch.column(c) for c in ("guest", "doc_id", "text")), strict=True):
                own_text = text.as_py()
                # A text that repeats the one before has its fingerprint.
                if last is not None and last[0] == own_text:
                    now = last
                else:
                    chosen = winnow(own_text)
                    now = (own_text, chosen, chosen.written())
                if not guest.as_py():
                    changed = edited(own_text, last[0])
                    after = now[1] if changed == own_text else winnow(changed)
                    out.append((doc_id.as_py(), len(own_text), hashlib.sha256(changed.encode()).hexdigest(), now[2], after.written(), likeness(now[1], after), likeness(now[1], last[1])))
                last = now
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", *[f.split(" ")[0] for f in COMPARED.split(", ")]])

    return rows.mapInArrow(made, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COMPARED}")
