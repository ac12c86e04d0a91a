"""Centroid clustering on integer vectors, with the dot products of every vector and centroid kept and mended.

Components x become floor(SCALE * x), x as double. A table in the shared folder holds for every vector its integers, its
squared length and its exact dot product with each centroid. When the centroids move, only their components that differ
count: the dot product with a centroid grows by the sum, over those, of the vector's component times the difference; a
centroid that stays costs nothing. The nearest centroid is then the least of |c|^2 - 2 dot (|v|^2 is the same for all), of
equal ones that of the smallest number. Everything is integer arithmetic, so the results don't depend on the order of
rows or on the number of tasks.

A round is one pass that mends the dot products and assigns, and one that sums components by cluster (partly in each
task, then a row a cluster and task is shuffled). Only k centroids come to the driver and go to the executors. The table of
the round before is deleted when the next one is written. Once no centroid moves, the rounds left can't change anything
and aren't run.

Rows whose vector is null, has another number of components, or one that is null or not finite aren't clustered. Components
are held to +-LARGEST, so that sums of products fit 64 bits (at the scale of 1024 that concerns components beyond
131,072 only). Repeated rows and ids, and null ids, are vectors like others; for the start, null ids come last, and equal
ids in the order of their integers. With fewer vectors than k there are as many centroids as vectors; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.llm.tables import dropped, stored

DIM, SCALE, K, ROUNDS, SALT = 64, 1024, 8, 10, "3:"
LARGEST = 1 << 27

_STATE = "vec_id long, v array<int>, norm long, dots array<long>, cluster int, distance long"
_SUMS = "cluster int, n long, sums array<long>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), values.shape[1]).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))


def kept(vectors: DataFrame, column: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and the integers v of every vector that has dim components, all of them finite."""

    def whole(x: Column) -> Column:
        return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(scale) * x.cast("double")))).cast("int")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("e"))
    return rows.where((F.size("e") == dim) & F.forall("e", finite)).select("vec_id", F.transform("e", whole).alias("v"))


def start(vectors: DataFrame, k: int = K, salt: str = SALT) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of salt and id, in ascending order: k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [r.v for r in vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]


def mended(state: DataFrame, before: np.ndarray, now: np.ndarray) -> DataFrame:
    """The state with dot products of the centroids `now` instead of `before` (both k x dim), and the nearest of them."""
    width, k = now.shape[1], len(now)
    change = now - before
    moved = [(c, np.flatnonzero(change[c]), change[c][change[c] != 0]) for c in range(k) if change[c].any()]
    lengths = (now * now).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), width)
            norm, dots = b.column(2).to_numpy(), _matrix(b.column(3), k).copy()
            for c, at, by in moved:
                dots[:, c] += v[:, at].astype(np.int64) @ by
            far = lengths - 2 * dots
            nearest = far.argmin(axis=1) if len(far) else np.zeros(0, np.int64)
            distance = norm + far[np.arange(len(far)), nearest]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists(dots), pa.array(nearest.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "norm", "dots", "cluster", "distance"])

    return state.mapInArrow(run, _STATE)


def summed(state: DataFrame, dim: int, k: int) -> DataFrame:
    """n and sums by component of every cluster that has vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            cluster, v = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            for c in np.unique(cluster):
                own = v[cluster == c]
                n[c] += len(own)
                sums[c] += own.sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), _lists(sums[some])], names=["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(run, _SUMS)
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *total)


def clustered(vectors: DataFrame, column: str = "embedding", dim: int = DIM, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, salt: str = SALT) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, norm, dots, cluster, distance) of every kept vector after the rounds, and the centroids."""
    spark = vectors.sparkSession
    first = stored(kept(vectors, column, dim, scale))
    whole = spark.read.parquet(first)
    centroids = np.array(start(whole, k, salt), np.int64).reshape(-1, dim)
    if not len(centroids):
        return spark.createDataFrame([], _STATE), []
    k = len(centroids)
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    none = F.array_repeat(F.lit(0).cast("long"), k)
    state = whole.select("vec_id", "v", norm.alias("norm"), none.alias("dots"))
    before, path = np.zeros_like(centroids), first
    for left in range(rounds, -1, -1):
        newer = stored(mended(state.select("vec_id", "v", "norm", "dots"), before, centroids))
        dropped(spark, path)
        state, path, before = spark.read.parquet(newer), newer, centroids
        if not left:
            break
        centroids = centroids.copy()
        for r in summed(state, dim, k).collect():
            centroids[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
        if (centroids == before).all():
            break
    return state, centroids.tolist()


def clusters(vectors: DataFrame, **how: object) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and cluster_size for every kept vector."""
    state, centroids = clustered(vectors, **how)
    spark = vectors.sparkSession
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    by = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()  # k rows
    total, most = sum(int(r.s) for r in by), (1 << 63) - 1
    facts = [(r.cluster, int(r.s) if r.s <= most else None, total if total <= most else None, digests[r.cluster], r.n) for r in by]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")
