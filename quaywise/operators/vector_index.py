"""Inverted-list index for approximate nearest vectors: cells by centroids, queries meet the vectors of a few cells only.

The centroids are fitted on a bounded sample (the ids with the smallest digests, SAMPLE at most), by Lloyd rounds from its
first vectors. Every vector of the table is then given to its nearest cell, and a query to its nearest ones; an
equi-join on the cell brings them together, in groups of bounded size (a cell with many vectors or queries is dealt into
parts), and exact similarities rank them. What is stored is a table partitioned by cell, so that a search for few
queries reads few folders.

Cells go by direction: a vector's components over its largest one become 16-bit integers, these over their length become
integers of UNIT, and everything behind that is exact integer arithmetic, so that cells depend neither on the order of rows
nor on the engine. A vector without a direction (null, empty, all zeros, a component that isn't finite) is in no cell
and is never found, as its cosine isn't defined. Of vectors that are equal only the k smallest ids can be among the k
best, so others don't come into a search, however many copies there are.

How many cells a query has to meet depends on the data: few where vectors lie in groups, most where they lie anywhere, as
random ones do. So `fitted` tries it out on the sample; `recall` measures a search against the exact one.
"""

from __future__ import annotations

import math
import statistics
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaywise.operators import retrieval

#: Vectors that centroids are fitted on, cells, and Lloyd rounds at most; length of a direction.
SAMPLE, MOST_CELLS, ROUNDS, UNIT = 16_384, 2048, 3, 4096
#: Share of the nearest vectors to be found, sampled directions that it is tried with, and rows of a group.
RECALL, TRIED, BLOCK = 0.92, 256, 8192


def directions(batch: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, directions as integers) of the vectors of a batch that have one, for each number of components."""
    out, lengths = [], np.array(batch.value_lengths().fill_null(0))
    for size in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == size)
        x = batch.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls become NaN
        most = np.abs(x).max(axis=1)
        fine = np.isfinite(x).all(axis=1) & (most > 0)
        x, most, at = x[fine], most[fine], at[fine]
        whole = np.floor(x / most[:, None] * 32767.0)
        out.append((at, np.floor(float(UNIT) * whole / np.sqrt((whole * whole).sum(axis=1))[:, None])))
    return out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def direction(vectors: pa.Array) -> pa.Array:
    """The integers that say where a vector points, or null."""
    rows: list[np.ndarray | None] = [None] * len(vectors)
    for at, u in directions(vectors):
        for i, row in zip(at.tolist(), u.astype(np.int32), strict=True):
            rows[i] = row
    return pa.array(rows, pa.list_(pa.int32()))


direction = direction.asNondeterministic()  # else a filter on it computes it again, in a second Python worker of the task


def cells_for(n: int) -> int:
    """About the square root of the number of vectors."""
    return max(1, min(MOST_CELLS, math.isqrt(max(n - 1, 0)) + 1))


def _nearest(u: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The cells whose centroids are nearest to each direction, nearest first, of equal ones the smaller number first.

    Sums of products of these integers stay far below 2^53, so doubles are exact.
    """
    far = (centroids * centroids).sum(axis=1)[None, :] - 2.0 * (u.astype(np.float64) @ centroids.T)
    return np.argsort(far, axis=1, kind="stable")[:, :probes]


@dataclass(frozen=True)
class Cells:
    """Centroids, and the number of nearest cells that a query has to meet to find what it is after."""

    centroids: np.ndarray
    probes: int


def fitted(vectors: DataFrame, recall: float = RECALL, k: int = 10, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Cells:
    """Cells of a table of vectors (vec_id, embedding): at most `sample` rows come to the driver, ids and directions.

    Sampled are the ids with the smallest MD5; the first `cells` of them are the first centroids. A round gives every
    sampled direction to the nearest centroid and moves each to the floor of their mean; one without any stays. The number of
    probes is the smallest at which the first TRIED sampled directions find the wanted share of the k directions of the
    sample that are nearest to them (themselves aside). Vectors count whose number of components is the most common one. In a larger table the nearest are nearer, and are found oftener.
    """
    some = vectors.select("vec_id", direction("embedding").alias("u")).where(F.col("u").isNotNull())
    cells = cells or cells_for(vectors.count())
    rows = some.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "u").limit(sample).select("u").collect()
    if not rows:
        return Cells(np.zeros((0, 0)), 0)
    dim = statistics.mode(len(r.u) for r in rows)
    u = np.array([r.u for r in rows if len(r.u) == dim], np.float64)
    now = u[:cells].copy()
    for _ in range(rounds):
        of = _cell_of(u, now)
        for c in np.unique(of):
            own = u[of == c]
            now[c] = np.floor_divide(own.sum(axis=0), len(own))
    asked = u[:TRIED]
    order = _nearest(asked, now, len(now))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(now))[None, :], axis=1)
    near = _nearest(asked, u, k + 1)
    others = near != np.arange(len(asked))[:, None]
    others[others.all(axis=1), -1] = False  # an equal direction came before the asked one: k of the others all the same
    found = np.sort(np.take_along_axis(place, _cell_of(u, now)[near], axis=1)[others]) + 1
    return Cells(now, int(found[math.ceil(recall * len(found)) - 1]) if len(found) else len(now))


def _cell_of(u: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([_nearest(u[at : at + 1024], centroids, 1)[:, 0] for at in range(0, len(u), 1024)])


def _with_cells(rows: DataFrame, centroids: np.ndarray, probes: int, vector: str) -> DataFrame:
    """rows with their nearest cells (array, empty for vectors without a direction or of another number of components); the
    centroids (2048 at most) go to the executors."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def near(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in (v.slice(at, 1024) for v in vectors for at in range(0, len(v), 1024)):
            found = np.zeros((len(batch), min(probes, len(sent.value))), np.int32)
            known = np.zeros(len(batch), bool)
            for rows_at, u in directions(batch):
                if len(rows_at) and u.shape[1] == sent.value.shape[1]:
                    found[rows_at], known[rows_at] = _nearest(u, sent.value, probes), True
            ends = np.concatenate(([0], np.cumsum(known * found.shape[1]))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found[known].reshape(-1)))

    return rows.withColumn("cells", near.asNondeterministic()(F.col(vector)))  # computed once, see direction


def indexed(vectors: DataFrame, cells: Cells) -> DataFrame:
    """Every vector that has a direction with its cell: vec_id, embedding, cell, and whatever else vectors has."""
    return _with_cells(vectors, cells.centroids, 1, "embedding").where(F.size("cells") > 0).withColumn("cell", F.col("cells")[0]).drop("cells")


def saved(index: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes an index, a folder for each cell; mode append adds vectors to one that is there."""
    index.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4))).write.partitionBy("cell").mode(mode).parquet(path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def probed(queries: DataFrame, cells: Cells) -> DataFrame:
    """(query_id, query, cell): a row for each of a query's nearest cells."""
    return _with_cells(queries.select("query_id", "query"), cells.centroids, cells.probes, "query").select("query_id", "query", F.explode("cells").alias("cell"))


def _parts(rows: DataFrame, name: str, block: int) -> DataFrame:
    """For each cell, the number of parts of about `block` rows."""
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))


def search(index: DataFrame, asked: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, similarity and rank of the k best vectors among those in the probed cells (see `probed`).

    Cells nobody asks for are left out by a semi-join before anything is dealt. Ties are ordered by id.
    """
    if metric not in ("cosine", "ip", "l2") or not 1 <= k <= 100:
        raise ValueError("the metric is cosine, ip or l2, and k lies between 1 and 100")
    wanted = index.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi").select("cell", "vec_id", "embedding")  # 2048 cells at most
    copy = F.row_number().over(W.partitionBy("cell", F.xxhash64("embedding"), "embedding").orderBy("vec_id"))
    wanted = wanted.withColumn("_c", copy).where(F.col("_c") <= k).drop("_c")
    parts = F.broadcast(_parts(wanted, "_nv", block).join(_parts(asked, "_nq", block), "cell"))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wanted.select("cell", F.col("vec_id").alias("id"), retrieval.numbers(wanted, "embedding").alias("v")).join(parts, "cell").withColumn("vb", deal("id", "_nv")).withColumn("qb", every("_nq")).drop("_nv", "_nq")
    right = asked.select("cell", F.col("query_id").alias("id"), retrieval.numbers(asked, "query").alias("v")).join(parts, "cell").withColumn("qb", deal("id", "_nq")).withColumn("vb", every("_nv")).drop("_nv", "_nq")
    group = ["cell", "vb", "qb"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(retrieval.best_of(metric, k), retrieval.FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact results (query_id, vec_id) that were found: recall, and how many results there are."""
    hits = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left")
    return hits.agg((F.count("_hit") / F.count("*")).alias("recall"), F.count("*").alias("results"))
