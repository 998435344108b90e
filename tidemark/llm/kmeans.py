"""Centroid clustering in integers, with Hamerly's bounds.

Components become integers, so distances, sums and ties are exact. Each vector keeps its cluster and two
numbers: an upper bound of its distance to its centroid and a lower bound of that to the second
nearest. After a round the upper one grows by how far its own centroid moved, the lower one shrinks by the
farthest move of the others. A vector whose upper bound stays below the lower one, or below half the way
from its centroid to the next, keeps its cluster; if not, its own distance is measured, and if that does not
decide, all centroids are scanned in exact integers. Bounds are rounded away from each other, so that no tie is
passed over. A stored table holds the bounds and the vectors, as bytes of 2 or 4 a component.

Sums of a round are taken per task and then per cluster, so a cluster may hold any share of the vectors.
The driver holds the centroids alone.

Defined results: vectors of another length, with a null, or not finite are left out; a null id is an empty
one; of rows that repeat an id each may be a seed, the least bytes first; with fewer vectors than clusters
there are fewer centroids; a component whose integer is beyond 2^27 is an error, as squared
distances would not fit 64 bits; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import cut

#: Largest integer of a component, and the one up to which products of 64 components are exact as doubles.
LIMIT, DOUBLE_LIMIT = 2**27, 2**22
#: Bounds are kept apart by this share of themselves.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Config:
    clusters: int = 16
    size: int = 64
    rounds: int = 3
    #: Integers are floor(scale * component).
    scale: float = 64.0
    seed: str = "1:"


def _packed(vectors: DataFrame, config: Config) -> DataFrame:
    """vec_id and the integer vector as bytes, of those that are kept."""
    values = F.col("embedding").cast("array<double>")
    good = (F.size(values) == config.size) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(config.scale * batch.column("v").flatten().to_numpy().reshape(-1, config.size))
            if len(x) and np.abs(x).max() > LIMIT:
                raise ArithmeticError(f"a component beyond {LIMIT} / {config.scale:g}: squared distances would not fit 64 bits")
            small = np.abs(x).max(axis=1, initial=0) < 2**15
            rows = [r.astype("<i2" if s else "<i4").tobytes() for r, s in zip(x, small, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.binary())], ["vec_id", "x"])

    kept = vectors.where(F.col("embedding").isNotNull()).where(good).select("vec_id", values.alias("v"))
    return kept.mapInArrow(pack, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x binary")


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    rows = column.to_pylist()
    found = np.empty((len(rows), size), dtype=np.int64)
    for i, row in enumerate(rows):
        found[i] = np.frombuffer(row, dtype="<i2" if len(row) == 2 * size else "<i4")
    return found


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < DOUBLE_LIMIT:
        products = (x.astype(float) @ centroids.T.astype(float)).astype(np.int64)
        return (x * x).sum(axis=1)[:, None] - 2 * products + (centroids * centroids).sum(axis=1)[None, :]
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _own(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (of equal ones the first), its squared distance, and bounds from a full scan."""
    d = squares(x, centroids)
    cluster = d.argmin(axis=1)
    nearest = d[np.arange(len(d)), cluster]
    d[np.arange(len(d)), cluster] = np.iinfo(np.int64).max
    return cluster, nearest, np.sqrt(nearest) * (1 + ROUNDING), np.sqrt(d.min(axis=1).astype(float)) * (1 - ROUNDING)


def step(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, squared distance and bounds after the centroids moved; and how many rows were scanned."""
    moved = np.sqrt(((new - old) ** 2).sum(axis=1).astype(float)) * (1 + ROUNDING)
    most = np.full(len(new), moved.max())
    # The farthest move of the others.
    most[moved.argmax()] = np.partition(moved, -2)[-2] if len(new) > 1 else 0.0
    between = np.sqrt(squares(new, new).astype(float))
    np.fill_diagonal(between, np.inf)
    half = between.min(axis=1) / 2 * (1 - ROUNDING)
    cluster, upper = cluster.copy(), (upper + moved[cluster]) * (1 + ROUNDING)
    lower = np.maximum((lower - most[cluster]) * (1 - ROUNDING), 0.0)
    distance = _own(x, new, cluster)
    doubtful = upper >= np.maximum(lower, half[cluster])
    upper[doubtful] = np.sqrt(distance[doubtful]) * (1 + ROUNDING)
    doubtful &= upper >= np.maximum(lower, half[cluster])
    at = np.flatnonzero(doubtful)
    if len(at):
        cluster[at], distance[at], upper[at], lower[at] = scan(x[at], new)
    return cluster, distance, upper, lower, len(at)


def _seeds(packed: DataFrame, config: Config) -> np.ndarray:
    name = F.concat(F.lit(config.seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = packed.select(F.sha2(name, 256).alias("key"), "x").orderBy("key", "x").limit(config.clusters).collect()
    return _unpacked(pa.array([r["x"] for r in rows], pa.binary()), config.size)


STATE = "x binary, cluster int, distance long, upper double, lower double"


def _assigned(state: DataFrame, old: np.ndarray | None, new: np.ndarray, config: Config) -> DataFrame:
    """The state after one assignment: by a full scan at first (old is None), then by the bounds."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unpacked(batch.column("x"), config.size)
            if old is None:
                cluster, distance, upper, lower = scan(x, new)
            else:
                bounds = [batch.column(c).to_numpy() for c in ("cluster", "upper", "lower")]
                cluster, distance, upper, lower, _ = step(x, *bounds, old, new)
            columns = [pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), *columns], ["vec_id", "x", "cluster", "distance", "upper", "lower"])

    return cut(state.mapInArrow(assign, f"vec_id {state.schema['vec_id'].dataType.simpleString()}, {STATE}"))


def _moved(state: DataFrame, centroids: np.ndarray, config: Config) -> np.ndarray:
    """Centroids at the floor of their vectors' means; those of none stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            cluster = batch.column("cluster").to_numpy()
            x = _unpacked(batch.column("x"), config.size)
            for c in np.unique(cluster):
                own = cluster == c
                total[c] += x[own].sum(axis=0)
                n[c] += own.sum()
        at = np.flatnonzero(n)
        each = at.repeat(config.size), np.tile(np.arange(config.size), len(at))
        yield pa.RecordBatch.from_arrays([pa.array(each[0], pa.int32()), pa.array(each[1], pa.int32()), pa.array(total[at].ravel()), pa.array(n[each[0]])], ["cluster", "place", "total", "n"])

    parts = state.select("x", "cluster").mapInArrow(sums, "cluster int, place int, total long, n long")
    found = centroids.copy()
    # At most clusters x size rows.
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        found[r["cluster"], r["place"]] = r["total"] // r["n"]
    return found


def fit(vectors: DataFrame, config: Config = Config()) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance (and the bounds) of every vector that is kept, stored; and the final centroids."""
    packed = cut(_packed(vectors, config))
    old, new = None, _seeds(packed, config)
    if not len(new):
        return packed.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), new
    state = packed
    for _ in range(config.rounds):
        state = _assigned(state, old, new, config)
        old, new = new, _moved(state, new, config)
    return _assigned(state, old, new, config), new


def sha_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def report(vectors: DataFrame, config: Config = Config()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and the hash of the cluster's centroid."""
    state, centroids = fit(vectors, config)
    # One row a cluster.
    sums = {r["cluster"]: r["inertia"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    rows = [(c, n, sum(sums.values()), sha_of(centroids[c])) for c, n in sums.items()]
    table = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
