import datetime
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from quaywise.operators import anomaly, forest
from quaywise.plans import catalogue as demand
from quaywise.plans.models import part_prices

DATA = "/root/testdata/sf0.001"


def walked(f, x):
    """Every row down every tree, one at a time."""
    out = []
    for row in x:
        total = 0.0
        for t in range(len(f.feature)):
            node = 0
            while f.feature[t][node] >= 0:
                node = 2 * node + 1 + int(row[f.feature[t][node]] >= f.cut[t][node])
            total += f.length[t][node]
        out.append(2 ** (-total / len(f.feature) / f.usual))
    return out


def test_scores_are_those_of_a_walk():
    x = np.random.default_rng(1).normal(size=(300, 5))
    x[7] = [9, -8, 7, 9, 9]
    f = forest.grown(x, trees=30)
    got = forest.scores(f, x)
    assert got == pytest.approx(walked(f, x)) and got.argmax() == 7 and got[7] > 0.65 and abs(np.median(got) - 0.45) < 0.08
    # each tree keeps all its rows: the leaves' rows add up, seen through a tree grown from all of few rows
    few = forest.grown(x[:40], trees=1)
    ends = {}
    for row in x[:40]:
        node = 0
        while few.feature[0][node] >= 0:
            node = 2 * node + 1 + int(row[few.feature[0][node]] >= few.cut[0][node])
        ends[node] = ends.get(node, 0) + 1
    for node, n in ends.items():
        depth = int(math.log2(node + 1))
        assert few.length[0][node] == pytest.approx(depth + forest.usual(n)) and (n == 1 or depth == forest.LEVELS)
    same = forest.grown(np.ones((20, 5)))
    assert (forest.scores(same, np.ones((3, 5))) == forest.scores(same, np.zeros((3, 5)))).all() and len(forest.scores(forest.grown(x[:0]), x[:0])) == 0


def test_registered_rows_match_plain_rules(spark):
    rows = part_prices(spark, DATA)
    framed = forest.frame(rows, ["k"], "y", "price", "residual")
    f = forest.fitted(framed)
    got = {(r.k, r.date): r for r in forest.isolated(rows, ["k"], "y", "price", "residual").collect()}
    by = {}
    for r in framed.orderBy("k", "date").collect():
        by.setdefault(r.k, []).append(r)
    some = sorted(by)[::6]
    assert len(by) > 100 and len(got) == demand.QUERIES["forest_anomalies"](spark, DATA).count() > 0
    for k in some:
        s = by[k]
        cols = [[r.y for r in s], [r.price for r in s], [r.date.month for r in s], [r.date.timetuple().tm_yday for r in s], [r.residual for r in s]]
        std = lambda c: [(v - statistics.fmean(c)) / (statistics.pstdev(c) or 1.0) for v in map(float, c)]
        x = np.array([std(c) for c in cols]).T
        assert np.allclose(x, np.array([r.x for r in s]))
        if len(s) < 10:
            assert not any(key == k for key, _ in got)
            continue
        raw = np.array(walked(f, np.array([r.x for r in s])))
        scaled = (raw - raw.min()) / (raw.max() - raw.min())
        want = {s[i].date for i in range(len(s)) if raw[i] >= np.quantile(raw, 0.92) - 1e-12 and scaled[i] >= 0.55}
        assert {d for key, d in got if key == k} == want
        for i, r in enumerate(s):
            if r.date in want:
                g = got[k, r.date]
                assert g.forest_score == pytest.approx(scaled[i]) and g.severity == "medium"
                z = (r.residual - statistics.fmean(cols[4])) / (statistics.stdev(cols[4]) or 1.0)
                near = [s[j].y for j in range(max(0, i - 3), min(len(s), i + 4)) if j != i]
                expected = sum(map(float, near)) / len(near)
                assert g.z == pytest.approx(z) and g.expected == pytest.approx(expected)
                kind = anomaly.DATA_QUALITY if r.y == 0 < expected else anomaly.SPIKE if z >= 2.5 else anomaly.DROP if z <= -2.5 else anomaly.GRADUAL
                assert g.anomaly_type == kind


def test_planted_rows_are_found(spark):
    day = lambda i: datetime.date(2018 + i // 12, i % 12 + 1, 1)
    rows = [(k, day(i), 100.0 + 10 * math.sin(i) + len(k), 5.0) for k in ("a", "bb", "ccc") for i in range(48)] + [("short", day(i), float(i), 1.0) for i in range(9)] + [("one price", day(i), 3.0, None) for i in range(12)]
    rows[20] = ("a", day(20), 900.0, 50.0)
    rows[48 + 30] = ("bb", day(30), 0.0, 0.0)
    df = anomaly.decomposed(spark.createDataFrame(rows, "k string, date date, y double, price double"), ["k"], "y")
    got = {(r.k, r.date): (r.anomaly_type, round(r.forest_score, 6)) for r in forest.isolated(df, ["k"], "y", "price", "residual").collect()}
    assert got["a", day(20)] == (anomaly.SPIKE, 1.0) and got["bb", day(30)] == (anomaly.DATA_QUALITY, 1.0) and not any(k == "short" for k, _ in got)
    assert forest.isolated(df.where("1 = 0"), ["k"], "y", "price", "residual").collect() == []
    assert df.where(F.col("k") == "a").count() == 48
