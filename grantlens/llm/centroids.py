"""Clustering by centroids with an incremental distance matrix, in whole numbers.

Vectors become integers once. Beside each vector its exact dot product with every centroid is kept. The
squared distance to centroid c is |v|² - 2 v·c + |c|², so a round needs the dot products alone. When a
centroid moves, a dot product changes by the moved components times the vector's own: a round adds
just those, takes the nearest centroid, and writes vectors, dot products and clusters as a table in the
shared folder, from which the next round goes on. Component sums of the clusters leave each task once;
the driver sees sums per cluster, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

#: Components from this size on could give squared distances that no long holds.
TOO_LARGE = 1 << 26


class Settings(NamedTuple):
    clusters: int = 8
    rounds: int = 10
    size: int = 64
    scale: int = 1024


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def kept(vectors: DataFrame, settings: Settings, key: str, vector: str) -> DataFrame:
    """(key, vec) of the vectors that take part, in whole numbers."""
    real = vectors.select(F.col(key).alias("key"), F.col(vector).alias("vec")).where(F.size("vec") == settings.size)
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = real.where(finite).select("key", integers(F.col("vec"), settings.scale).alias("vec"))
    return whole.where(F.forall("vec", lambda x: (x > -TOO_LARGE) & (x < TOO_LARGE))).withColumn("vec", F.col("vec").cast("array<int>"))


def seeds(state: DataFrame, settings: Settings, salt: str) -> np.ndarray:
    """The vectors whose salted keys have the smallest SHA-256, smallest first; of one key, the smaller vector first."""
    hashed = state.select(F.sha2(F.concat(F.lit(salt), F.col("key").cast("string")), 256).alias("h"), "vec")
    rows = hashed.orderBy(F.col("h").asc_nulls_last(), "vec").limit(settings.clusters).collect()
    return np.array([r.vec for r in rows], np.int64).reshape(len(rows), settings.size)


def moved(before: np.ndarray, after: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(centroid, components, changes) of the components that a round changed."""
    change = after - before
    return [(c, at, change[c, at]) for c in range(len(change)) for at in [np.flatnonzero(change[c])] if len(at)]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def updated(dots: np.ndarray, vec: np.ndarray, moves: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The dot products after the moves: only changed components are multiplied."""
    for c, at, change in moves:
        dots[:, c] += vec[:, at] @ change
    return dots


def assigned(state: DataFrame, centroids: np.ndarray, moves: list, first: bool) -> DataFrame:
    """(key, vec, dots, cluster, distance) with dot products brought up to date; ties go to the smaller number."""
    key, (count, size) = state.schema["key"].dataType.simpleString(), centroids.shape
    norms = (centroids ** 2).sum(axis=1)
    names = ["key", "vec", "dots", "cluster", "distance"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                vec = matrix(batch.column(1), size).astype(np.int64)
                dots = np.zeros((len(vec), count), np.int64) if first else matrix(batch.column(2), count).astype(np.int64)
                dots = updated(dots, vec, moves)
                distance = (vec ** 2).sum(axis=1)[:, None] - 2 * dots + norms
                cluster = distance.argmin(axis=1)
                ends = pa.array(np.arange(len(vec) + 1, dtype=np.int32) * count)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(dots.ravel())),
                     pa.array(cluster.astype(np.int32)), pa.array(distance[np.arange(len(vec)), cluster])], names)

    columns = ["key", "vec"] if first else ["key", "vec", "dots"]
    return state.select(*columns).mapInArrow(rows, f"key {key}, vec array<int>, dots array<long>, cluster int, distance long")


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean by component; an empty cluster's centroid stays."""
    count, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, size + 1), np.int64)
        for batch in batches:
            vec, cluster = matrix(batch.column(0), size), batch.column(1).to_numpy()
            for c in np.unique(cluster):
                own = cluster == c
                total[c] += np.r_[vec[own].sum(axis=0, dtype=np.int64), own.sum()]
        c = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, size + 1)), pa.array(np.tile(np.arange(size + 1), len(c))), pa.array(total[c].ravel())],
                                         ["cluster", "at", "total"])

    parts = state.select("vec", "cluster").mapInArrow(sums, "cluster long, at long, total long")
    after = centroids.copy()
    totals: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():  # clusters × (size + 1) numbers
        totals.setdefault(r.cluster, {})[r.at] = int(r.total)
    for c, own in totals.items():
        after[c] = [own[i] // own[size] for i in range(size)]
    return after


class Clustering(NamedTuple):
    vectors: DataFrame  # (key, vec, dots, cluster, distance)
    centroids: np.ndarray


def cluster(vectors: DataFrame, settings: Settings = Settings(), salt: str = "3:", key: str = "vec_id", vector: str = "embedding") -> Clustering:
    """Lloyd's rounds from the seeds, then one more assignment.

    Vectors of another size, null ones, and ones with a null or non-finite component or one that is
    2^26 or more in whole numbers take no part. Rows without a key do, but seed only where there are
    too few others. Repeated rows count as rows and may seed twice. Without vectors the table is empty.
    """
    state = stage(kept(vectors, settings, key, vector), "vectors")
    centroids = seeds(state, settings, salt)
    if not len(centroids):
        centroids = np.zeros((1, settings.size), np.int64)
    before, first = np.zeros_like(centroids), True
    for left in range(settings.rounds, -1, -1):
        after = stage(assigned(state, centroids, moved(before, centroids), first), "rounds")
        discard(state)
        state, first, before = after, False, centroids
        if left:
            centroids = means(state, centroids)
            if np.array_equal(centroids, before):  # no later round would change anything
                break
    return Clustering(state, centroids)


def long_or_null(n: int) -> int | None:
    return n if abs(n) < 1 << 63 else None


def report(found: Clustering, key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) per vector. An inertia beyond a long is null."""
    sums = found.vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # a row per cluster
    own = {r.cluster: int(r.own) for r in sums}
    told = [(c, long_or_null(own.get(c, 0)), long_or_null(sum(own.values())), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
            for c, row in enumerate(found.centroids.tolist())]
    clusters = found.vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.vectors.select(F.col("key").alias(key), "cluster", "distance").join(F.broadcast(clusters), "cluster").select(
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
