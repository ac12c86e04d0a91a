"""Gradient-boosted trees over the feature frames of all series: one model, splits from histograms, importances from gains.

The frame is that of `regression`: features of one size whatever the series, so that what one series shows serves the others.
Each feature is cut into bins at its quantiles once; a row then is its bins and its residual. A level of a tree is one
aggregation over all rows: the sums of residuals and the numbers of rows by node, feature and bin, pre-aggregated in each
task. Of these, at most nodes times features times bins rows, the driver takes each node's best split. Trees are small
arrays in the plan. Residuals are integers of 2^-20, so sums don't depend on the order of rows.

A node is split where the gain is greatest, half of GL^2/(nL + L2) + GR^2/(nR + L2) - G^2/(n + L2) with the sums G of
residuals, of equal ones at the first feature and bin, and only where it is above 0 and both sides have LEAST_ROWS; a leaf
predicts rate * G/(n + L2). Each tree learns from nine tenths of the rows, and of the features, by CRC-32 of what they are and
the number of the tree. Forecasts are a fold over the steps as in `regression`, with one fit.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.operators import regression
from quaywise.session import cut

FEATURES = regression.FEATURES[1:]
#: Levels of a tree, bins of a feature, weight against small leaves, least rows of a leaf, unit of residuals, trees between two cuts of lineage.
DEPTH, BINS, L2, LEAST_ROWS, UNIT, KEEP = 4, 32, 1.0, 5, float(1 << 20), 5


@dataclass
class Tree:
    """Nodes in order of levels, the children of i being 2i + 1 and 2i + 2; a node that isn't split sends every row left."""

    feature: list[int]
    cut: list[float]
    bin: list[int]
    leaf: list[float]


@dataclass
class Model:
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    #: (feature, gain) of every split.
    splits: list[tuple[int, float]] = field(default_factory=list)


def left_out(tree: int, name: str) -> bool:
    """Whether a tree doesn't learn from what has this name."""
    return zlib.crc32(f"{tree}|{name}".encode()) % 10 == 0


def _edges(rows: DataFrame, bins: int) -> list[list[float]]:
    """For each feature its distinct quantiles, the least and the greatest aside; exact up to some thousand rows, near it beyond."""
    at = [k / bins for k in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col("x")[i + 1], at, 10_000).alias(f"q{i}") for i in range(len(FEATURES))]).first()
    return [sorted(set(q or [])) for q in got]


def _arrays(model: Model) -> Column:
    """The trees as an array of structs."""
    one = lambda t: F.struct(F.lit(t.feature).alias("feature"), F.lit(t.cut).alias("cut"), F.lit(t.leaf).alias("leaf"))
    return F.array(*map(one, model.trees))


def predicted(model: Model, x: Column) -> Column:
    """The prediction for an array of features (without the intercept)."""
    if not model.trees:
        return F.lit(model.base)
    right = lambda t, node: (F.get(x, F.get(t["feature"], node)) > F.get(t["cut"], node)).cast("int")
    leaf = lambda t: F.get(t["leaf"], F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), lambda node, _: 2 * node + 1 + right(t, node)) - F.lit((1 << DEPTH) - 1))
    return F.lit(model.base) + F.aggregate(_arrays(model), F.lit(0.0), lambda s, t: s + leaf(t))


def _node(tree: Tree, levels: int) -> Column:
    """The node of the given level that a binned row is in."""
    node = F.lit(0)
    for _ in range(levels):
        at = node
        node = F.transform(F.array(at), lambda n: 2 * n + 1 + (F.get("bins", F.get(F.lit(tree.feature), n)) > F.get(F.lit(tree.bin), n)).cast("int"))[0]
    return node


def best_split(g: np.ndarray, n: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node, from sums of residuals and numbers of rows by feature and bin."""
    gl, nl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    total, rows = g.sum(axis=1, keepdims=True), n.sum(axis=1, keepdims=True)
    gr, nr = total - gl, rows - nl
    gain = 0.5 * (gl * gl / (nl + L2) + gr * gr / (nr + L2) - total * total / (rows + L2))
    gain[(nl < LEAST_ROWS) | (nr < LEAST_ROWS)] = -np.inf
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[f, b]), int(f), int(b)) if gain[f, b] > 0 else None


def fit(rows: DataFrame, keys: list[str], trees: int = 250, rate: float = 0.05, bins: int = BINS) -> Model:
    """The model of a frame (see `regression.frame`); what comes to the driver are quantiles and the histograms of a level."""
    rows = rows.where((F.col("i") >= regression.BEFORE) & (F.col("n") >= regression.LEAST))
    base, count = rows.agg(F.avg(F.round(F.col("v") * UNIT).cast("long")), F.count("*")).first()
    model = Model(_edges(rows, bins), round((base or 0.0)) / UNIT)
    if not count:
        return model
    p, nodes = len(FEATURES), (1 << DEPTH) - 1
    below = lambda x, edges: F.size(F.filter(F.lit(edges).cast("array<double>"), lambda edge: edge < x)).cast("int")
    binned = F.array(*[below(F.col("x")[i], edges) for i, edges in enumerate(model.edges, 1)])
    name = F.concat_ws("|", *keys, "date")
    state = cut(rows.select(name.alias("name"), binned.alias("bins"), (F.round(F.col("v") * UNIT) - F.lit(model.base * UNIT)).cast("long").alias("r")))
    for t in range(trees):
        tree = Tree([0] * nodes, [float("inf")] * nodes, [bins] * nodes, [0.0] * (nodes + 1))
        seen = state.where(F.crc32(F.concat_ws("|", F.lit(t), "name")) % 10 != 0)
        off = [left_out(t, f) for f in FEATURES]
        for level in range(DEPTH + 1):
            cells = seen.select(_node(tree, level).alias("node"), "r", F.posexplode("bins").alias("f", "b")) if level < DEPTH else seen.select(_node(tree, level).alias("node"), "r", F.lit(0).alias("f"), F.lit(0).alias("b"))
            found = cells.groupBy("node", "f", "b").agg(F.sum("r").alias("g"), F.count("*").alias("n")).collect()
            if level == DEPTH:
                for c in found:
                    tree.leaf[c.node - nodes] = rate * (c.g / UNIT) / (c.n + L2)
                break
            g, n = np.zeros((2 << DEPTH, p, bins)), np.zeros((2 << DEPTH, p, bins))
            for c in found:
                if not off[c.f]:
                    g[c.node, c.f, c.b], n[c.node, c.f, c.b] = c.g / UNIT, c.n
            for node in {c.node for c in found}:
                if split := best_split(g[node], n[node]):
                    gain, f, b = split
                    tree.feature[node], tree.bin[node], tree.cut[node] = f, b, model.edges[f][b]
                    model.splits.append((f, gain))
        model.trees.append(tree)
        leaf = F.get(F.lit(tree.leaf), _node(tree, DEPTH) - F.lit(nodes))
        state = state.withColumn("r", F.col("r") - F.round(leaf * UNIT).cast("long"))
        if (t + 1) % KEEP == 0 and t + 1 < trees:
            state = cut(state)
    return model


def importances(model: Model) -> list[tuple[str, float, int]]:
    """(feature, mean gain of its splits, number of them), the most important first."""
    by: dict[int, list[float]] = {}
    for f, gain in model.splits:
        by.setdefault(f, []).append(gain)
    return sorted(((FEATURES[f], sum(g) / len(g), len(g)) for f, g in by.items()), key=lambda x: (-x[1], x[0]))


def forecast(model: Model, rows: DataFrame, keys: list[str], steps: int) -> DataFrame:
    """keys, step, date and yhat of every series of a frame that has enough months."""
    fine = rows.where(F.col("n") >= regression.LEAST)
    recent = regression.memory(fine, keys)
    ahead = regression.folded(steps, lambda x: predicted(model, F.array(*x[1:])))
    out = recent.withColumn("month", F.month("last_date")).select(*keys, "scale", "last_date", F.posexplode(ahead).alias("_k", "_v"))
    return out.select(*keys, (F.col("_k") + 1).alias("step"), F.add_months(F.trunc("last_date", "MM"), F.col("_k") + 1).alias("date"), (F.col("_v") * F.col("scale")).alias("yhat"))
