import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quaywise.operators import boosting as gb
from quaywise.operators import regression as reg
from quaywise.plans.models import TREES, boosted
from test_regression import DATA, features, made


@pytest.fixture(scope="module")
def series(spark):
    by = made(3) | {f"{k} again": v for k, v in made(4).items()}
    return by, spark.createDataFrame([(k, d, y) for k, rows in by.items() for d, y in rows], "k string, date date, y double").repartition(3)


def plain_rows(by):
    out = []
    for k, rows in by.items():
        y = [x for _, x in sorted(rows)]
        n, scale = len(y), sum(y) / len(y)
        if n >= 15 and scale > 0:
            v = [x / scale for x in y]
            out += [(f"{k}|{rows[i][0]}", features(v, i, n, rows[i][0].month)[1:], v[i]) for i in range(3, n)]
    return out


def plain_fit(rows, edges, trees, rate, bins):
    """Trees grown by trying every edge of every feature at every node, a row at a time.

    Values may differ by their last bit from those that the edges are of, so what is as near to an edge counts as on it.
    """
    unit = 1 << 20
    whole = [math.floor(v * unit + 0.5) for _, _, v in rows]
    base = round(sum(whole) / len(whole))
    r = [w - base for w in whole]
    out, gains = [], []
    for t in range(trees):
        seen = [i for i, (name, _, _) in enumerate(rows) if zlib.crc32(f"{t}|{name}".encode()) % 10]
        use = [f for f, name in enumerate(gb.FEATURES) if not gb.left_out(t, name)]

        def grow(some, depth):
            g, n = sum(r[i] for i in some) / unit, len(some)
            if depth == gb.DEPTH:
                return ("leaf", rate * g / (n + gb.L2) if some else 0.0)
            best = None
            for f in use:
                for b, edge in enumerate(edges[f]):
                    left = [i for i in some if rows[i][1][f] <= edge + 1e-12]
                    nl, gl = len(left), sum(r[i] for i in left) / unit
                    if nl < gb.LEAST_ROWS or n - nl < gb.LEAST_ROWS:
                        continue
                    gain = 0.5 * (gl * gl / (nl + gb.L2) + (g - gl) * (g - gl) / (n - nl + gb.L2) - g * g / (n + gb.L2))
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, b, edge)
            if best is None:
                return grow(some, depth + 1)
            gains.append((best[1], best[0]))
            left = [i for i in some if rows[i][1][best[1]] <= best[3] + 1e-12]
            right = [i for i in some if rows[i][1][best[1]] > best[3] + 1e-12]
            return ("split", best[1], best[3], grow(left, depth + 1), grow(right, depth + 1))

        tree = grow(seen, 0)
        out.append(tree)
        r = [x - math.floor(value(tree, rows[i][1]) * unit + 0.5) for i, x in enumerate(r)]
    return base / unit, out, gains


def value(tree, x):
    while tree[0] == "split":
        tree = tree[3] if x[tree[1]] <= tree[2] + 1e-12 else tree[4]
    return tree[1]


def test_trees_forecasts_and_gains_match_plain_python(spark, series):
    by, df = series
    frame = reg.frame(df, ["k"])
    model = gb.fit(frame, ["k"], trees=3, rate=0.3, bins=12)
    rows = plain_rows(by)
    base, trees, gains = plain_fit(rows, model.edges, 3, 0.3, 12)
    assert model.base == pytest.approx(base) and len(model.splits) == len(gains) > 20
    assert sorted(f for f, _ in model.splits) == sorted(f for f, _ in gains) and sum(g for _, g in model.splits) == pytest.approx(sum(g for _, g in gains))
    got = {r.name: r.p for r in frame.select(F.concat_ws("|", "k", "date").alias("name"), gb.predicted(model, F.slice("x", 2, 20)).alias("p")).collect()}
    predict = lambda x: base + sum(value(t, x) for t in trees)
    assert all(got[name] == pytest.approx(predict(x), abs=1e-9) for name, x, _ in rows)
    assert np.std([v - predict(x) for _, x, v in rows]) < 0.8 * np.std([v for _, _, v in rows])
    ahead = {(r.k, r.step): r.yhat for r in gb.forecast(model, frame, ["k"], 5).collect()}
    for k in ("long", "falling"):
        y = [x for _, x in by[k]]
        n, scale = len(y), sum(y) / len(y)
        v = [x / scale for x in y]
        for step in range(1, 6):
            i = n + step - 1
            v.append(max(0.0, predict(features(v, i, n, i % 12 + 1)[1:])))
            assert ahead[k, step] == pytest.approx(v[-1] * scale, abs=1e-6)
    assert not any(k in ("too short", "zeros") for k, _ in ahead)


def test_edges_are_quantiles(spark, series):
    by, df = series
    model = gb.fit(reg.frame(df, ["k"]), ["k"], trees=0)
    x = np.array([x for _, x, _ in plain_rows(by)])
    for f in range(x.shape[1]):
        edges = [-np.inf, *model.edges[f], np.inf]
        assert edges == sorted(set(edges)) and len(edges) <= 33
        assert max(((x[:, f] > a) & (x[:, f] < b)).mean() for a, b in zip(edges, edges[1:], strict=False)) < 0.05


def test_nothing_to_learn_from(spark, series):
    _, df = series
    frame = reg.frame(df.where("k = 'too short'"), ["k"])
    model = gb.fit(frame, ["k"], trees=2)
    assert model.trees == [] and gb.importances(model) == [] and gb.forecast(model, frame, ["k"], 3).collect() == []


def test_registered_model(spark):
    rows, model = boosted(spark, DATA)
    assert len(model.trees) == TREES and [g for _, g, _ in gb.importances(model)] == sorted((g for _, g, _ in gb.importances(model)), reverse=True)
    series = rows.where(F.col("n") >= reg.LEAST).select("k").distinct().count()
    assert 100 < series * 6 == gb.forecast(model, rows, ["k"], 6).where("yhat >= 0").count()
