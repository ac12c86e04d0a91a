"""An isolation forest over the rows of all series: grown on bounded samples, scored in one pass.

A row's features are its value, price, month, day of the year and residual, each over its own series' mean and deviation, so
that rows of all series lie on one scale and one forest serves them. The trees are grown on the driver from a bounded sample
(the SAMPLED rows with the smallest MD5 of series and date), each from SIZE rows of it, and go to the executors as arrays
of a few hundred kilobytes. Every row is scored where it is; what has to be known of its series (least and greatest score,
the quantile above which rows are set apart) are aggregates and windows by series.

Series of fewer than LEAST rows have no anomalies. Null features count as the mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaywise.functions.scalar import chain, ratio
from quaywise.operators.anomaly import DATA_QUALITY, DROP, GRADUAL, SPIKE
from quaywise.operators.series import neighbour_mean

FEATURES = ("value", "price", "month", "day_of_year", "residual")
#: Trees, rows that one is grown from, rows of the sample, levels, the seed, and rows of a series at least.
TREES, SIZE, SAMPLED, LEVELS, SEED, LEAST = 100, 256, 25_600, 8, 42, 10


@dataclass(frozen=True)
class Forest:
    """Of each tree and node (the children of i being 2i + 1 and 2i + 2) the feature, -1 for a leaf, the cut, and a leaf's path length."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray
    usual: float


def usual(n: int) -> float:
    """The mean path length of an unsuccessful search among n rows."""
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grown(x: np.ndarray, trees: int = TREES, size: int = SIZE, seed: int = SEED) -> Forest:
    """Trees that split at random between the least and the greatest value of a random feature that has two."""
    rng, n, nodes = np.random.default_rng(seed), len(x), (2 << LEVELS) - 1
    size = min(size, n)
    feature, cuts, length = np.full((trees, nodes), -1, np.int32), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees if n else 0):
        todo = [(0, 0, rng.choice(n, size, replace=False))]
        while todo:
            node, depth, own = todo.pop()
            spread = np.flatnonzero(np.ptp(x[own], axis=0)) if len(own) > 1 and depth < LEVELS else []
            if not len(spread):
                length[t, node] = depth + usual(len(own))
                continue
            f = rng.choice(spread)
            cut = rng.uniform(x[own, f].min(), x[own, f].max())
            feature[t, node], cuts[t, node] = f, cut
            todo += [(2 * node + 1, depth + 1, own[x[own, f] < cut]), (2 * node + 2, depth + 1, own[x[own, f] >= cut])]
    return Forest(feature, cuts, length, max(usual(size), 1e-9))


def scores(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Isolation scores (0 to 1, higher for rows that are split off early)."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for feature, cut, length in zip(forest.feature, forest.cut, forest.length, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(LEVELS):
            f = feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] >= cut[node]), node)
        total += length[node]
    return 2.0 ** (-total / max(len(forest.feature), 1) / forest.usual)


def frame(rows: DataFrame, keys: list[str], value: str, price: str, residual: str) -> DataFrame:
    """rows with x, the features over their series' mean and deviation, _n and _name."""
    w = W.partitionBy(*keys)
    raw = {"value": F.col(value), "price": F.col(price), "month": F.month("date"), "day_of_year": F.dayofyear("date"), "residual": F.col(residual)}
    rows = rows.withColumns({f"_{n}": c.cast("double") for n, c in raw.items()})
    one = lambda n: F.coalesce((F.col(f"_{n}") - F.avg(f"_{n}").over(w)) / F.coalesce(F.nullif(F.stddev_pop(f"_{n}").over(w), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    out = rows.withColumns({"x": F.array(*map(one, FEATURES)), "_n": F.count("*").over(w), "_name": F.concat_ws("|", *keys, "date")})
    return out.drop(*[f"_{n}" for n in FEATURES])


def fitted(framed: DataFrame, sampled: int = SAMPLED, **how: int) -> Forest:
    some = framed.where(F.col("_n") >= LEAST).orderBy(F.md5("_name"), "_name", "x").limit(sampled).select("x").collect()
    return grown(np.array([r.x for r in some]).reshape(-1, len(FEATURES)), **how)


def isolated(rows: DataFrame, keys: list[str], value: str, price: str, residual: str, contamination: float = 0.08, least: float = 0.55, threshold: float = 2.5) -> DataFrame:
    """Rows that the forest sets apart: those above the quantile of their series whose score, over the series' range, is `least` or
    more; with forest_score, z of the residual, expected value, variance_pct, anomaly_type and severity."""
    framed = frame(rows, keys, value, price, residual)
    sent = rows.sparkSession.sparkContext.broadcast(fitted(framed))

    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array) -> pa.Array:
        return pa.array(scores(sent.value, x.flatten().to_numpy().reshape(len(x), -1)), pa.float64())

    w = W.partitionBy(*keys)
    raw = framed.where(F.col("_n") >= LEAST).withColumn("_raw", score("x"))
    low, high = F.min("_raw").over(w), F.max("_raw").over(w)
    std = F.coalesce(F.nullif(F.stddev_samp(residual).over(w), F.lit(0.0)), F.lit(1.0))
    raw = raw.withColumns({"forest_score": F.coalesce(ratio(F.col("_raw") - low, high - low), F.lit(1.0)), "z": (F.col(residual) - F.avg(residual).over(w)) / std, "expected": neighbour_mean(value, keys)})
    bound = raw.groupBy(*keys).agg(F.percentile("_raw", 1 - contamination).alias("_bound"))
    found = raw.join(bound, keys).where((F.col("_raw") >= F.col("_bound")) & (F.col("forest_score") >= least))
    kind = chain([((F.col(value) == 0) & (F.col("expected") > 0), DATA_QUALITY), (F.col("z") >= threshold, SPIKE), (F.col("z") <= -threshold, DROP)], GRADUAL)
    return found.withColumns({"anomaly_type": kind, "severity": F.lit("medium"), "variance_pct": F.coalesce(ratio((F.col(value) - F.col("expected")) * 100, F.col("expected")), F.lit(-100.0))}).drop("x", "_n", "_name", "_raw", "_bound")
