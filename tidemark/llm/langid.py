"""Language ID: nearest of several clustered centroids per language, over TF-IDF byte-trigram vectors.

Texts are read whole. Bytes A-Z are lower-cased, other ASCII that is not a letter becomes a space,
and trigrams of the remaining bytes are hashed into DIMS counts. Inverse document frequencies come
from all training rows. Centroids come from spherical k-means over at most about SAMPLE distinct texts
a language, taken by a hash of the text (a documented bound). A text is given the language of its
nearest centroid; it is rejected when even that one is farther than any training row by a margin.

Defined results: a null text, or one without a letter, is `und` with score 0 and is rejected. So is
every text when nothing was learned. Rows with null lang teach nothing. Repeated rows are predicted
one by one; as samples, rows of one language and text count once. Of centroids at the same distance the
first is taken: languages are in order of their names. A very long text becomes one vector like any
other. A null doc_id counts as an empty id. An empty table gives an empty result. The model holds every
distinct lang of the training rows, so a column of free text is no lang.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 4096
#: Training rows a language that centroids are fitted to, about; languages with fewer give all.
SAMPLE = 600
CENTROIDS = 4
#: A text is rejected below this share of the lowest cosine seen in training.
MARGIN = 0.25
UNKNOWN = "und"

_ASCII_LETTER = re.compile(r"[A-Za-z]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32


def trigram_counts(data: bytes) -> np.ndarray:
    """Hashed counts of the byte trigrams of b' ' + folded text + b' '; runs of spaces count as they stand."""
    b = np.empty(len(data) + 2, dtype=np.uint32)
    b[0] = b[-1] = 32
    b[1:-1] = _FOLD[np.frombuffer(data, dtype=np.uint8)]
    if len(b) < 3:
        return np.zeros(DIMS, dtype=np.float32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    slot = (code * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
    return np.bincount(slot, minlength=DIMS).astype(np.float32)


def has_letter(text: str | None) -> bool:
    """Letters are what Unicode calls so; digits and numbers like \u00b2 or \u00bd are none."""
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def vectors(texts: list[str | None], idf: np.ndarray) -> np.ndarray:
    """One unit vector a text: (1 + log tf) * idf; zero where no trigram has weight."""
    out = np.zeros((len(texts), DIMS), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        if text:
            counts = trigram_counts(text.encode())
            seen = np.flatnonzero(counts)
            row[seen] = (1 + np.log(counts[seen])) * idf[seen]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=out, where=length > 0)


def spherical_kmeans(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Farthest-first seeds, then Lloyd's rounds by cosine. Deterministic for a given order of points."""
    chosen = [points.mean(axis=0)]
    for _ in range(min(k, len(points)) - 1):
        chosen.append(points[np.argmin(np.max(points @ np.array(chosen).T, axis=1))])
    centres = np.array(chosen)
    for _ in range(rounds):
        nearest = np.argmax(points @ centres.T, axis=1)
        for j in range(len(centres)):
            if len(own := points[nearest == j]):
                centres[j] = own.mean(axis=0)
        length = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.divide(centres, length, out=centres, where=length > 0)
    return centres


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: One row a centroid, and the place of its language.
    centres: np.ndarray
    owner: np.ndarray
    #: The lowest cosine of a training row to its nearest centroid, by language.
    floor: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in 0 to 1, and whether the text is rejected."""
        known = np.array([has_letter(t) for t in texts], dtype=bool)
        if not self.languages or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        cosine = vectors(texts, self.idf) @ self.centres.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(float), 0, 1)
        owner = self.owner[best]
        rejected = ~known | (score < MARGIN * self.floor[owner])
        return [self.languages[o] if k else UNKNOWN for o, k in zip(owner, known, strict=True)], np.where(known, score, 0.0), rejected


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _pieces(batch: pa.RecordBatch, column: str = "text", rows: int = 256) -> Iterator[list[str | None]]:
    texts = batch.column(column)
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows).to_pylist()


def fit(training: DataFrame) -> Model:
    """Learns from text and lang of the given rows. What reaches the driver is DIMS frequencies and the centroids."""
    rows = training.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(DIMS, dtype=np.int64), {}
        for batch in batches:
            for texts in _pieces(batch):
                for text in texts:
                    found += trigram_counts(text.encode()) > 0
            for lang in batch.column("lang").to_pylist():
                n[lang] = n.get(lang, 0) + 1
        keys = [None] * DIMS + list(n)
        yield pa.RecordBatch.from_arrays([pa.array([*range(DIMS), *[-1] * len(n)], pa.int32()), pa.array(keys, pa.string()), pa.array([*found.tolist(), *n.values()], pa.int64())], ["slot", "lang", "n"])

    counts = rows.mapInArrow(frequencies, "slot int, lang string, n long").groupBy("slot", "lang").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    idf, n = np.zeros(DIMS, dtype=np.float32), {}
    for slot, lang, count in zip(counts["slot"], counts["lang"], counts["n"], strict=True):
        if slot < 0:
            n[lang] = count
    total = sum(n.values())
    for slot, count in zip(counts["slot"], counts["n"], strict=True):
        if slot >= 0:
            idf[slot] = np.log((total + 1) / (count + 1)) + 0.05
    if not n:
        return Model([], np.zeros((0, DIMS)), np.zeros(0, dtype=int), np.zeros(0), idf)

    # About SAMPLE rows a language: those whose hash falls under the language's share of its range.
    shares = rows.sparkSession.createDataFrame([(lang, min(1.0, SAMPLE / count)) for lang, count in sorted(n.items())], "lang string, share double")
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    # All copies of a text are drawn together; one of them is enough.
    sample = drawn.select("lang", "text").distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = vectors(part.column("text").to_pylist(), idf)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(list(flat), pa.list_(pa.float32()))], ["lang", "v"])

    def cluster(group: pa.Table) -> pa.Table:
        points = np.stack(group.column("v").to_numpy(zero_copy_only=False))
        points = points[np.lexsort(points[:, :64].T)]  # an order that does not hang on the partitions
        centres = spherical_kmeans(points, CENTROIDS)
        low = float((points @ centres.T).max(axis=1).min())
        return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(centres), pa.string()), "floor": pa.array([low] * len(centres), pa.float64()), "v": pa.array(list(centres.astype(np.float32)), pa.list_(pa.float32()))})

    fitted = sample.mapInArrow(features, "lang string, v array<float>").groupBy("lang").applyInArrow(cluster, "lang string, floor double, v array<float>").toArrow()
    langs = sorted(set(fitted["lang"].to_pylist()))
    if not langs:
        return Model([], np.zeros((0, DIMS)), np.zeros(0, dtype=int), np.zeros(0), idf)
    order = sorted(range(fitted.num_rows), key=lambda i: fitted["lang"][i].as_py())
    owner = np.array([langs.index(fitted["lang"][i].as_py()) for i in order])
    centres = np.stack(fitted["v"].to_numpy())[order]
    floor = np.array([min(fitted["floor"][i].as_py() for i in order if owner[order.index(i)] == j) for j in range(len(langs))])
    return Model(langs, centres, owner, floor, idf)


def fit_documents(docs: DataFrame) -> Model:
    """Learns from the rows that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score, rejected = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array(~shared.value.predict(part.column("text").to_pylist())[2]))

    return docs.mapInArrow(known, docs.schema)
