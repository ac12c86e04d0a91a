import datetime
import math
import random

import numpy as np
import pytest
from quaywise.operators import regression as reg
from quaywise.plans import catalogue as demand
from quaywise.plans.models import monthly_parts

DATA = "/root/testdata/sf0.001"


def features(v, i, n, month):
    before = v[:i]
    mean = lambda k: sum(before[-k:]) / len(before[-k:])
    lag = lambda k: v[i - k] if i >= k else mean(12)
    return [1.0, i / n, round(math.sin(2 * math.pi * month / 12), 12), round(math.cos(2 * math.pi * month / 12), 12), lag(1), lag(2), lag(3), lag(12), mean(6), mean(12)]


def plain(rows, steps):
    """The same model by numpy, a series at a time: least squares with the ridge as more rows."""
    rows = sorted(rows)
    y = [float(x) for _, x in rows]
    n, scale = len(y), sum(y) / len(y)
    if n < 15 or scale <= 0:
        return None
    v, first = [x / scale for x in y], rows[0][0].month
    x = np.array([features(v, i, n, (first + i - 1) % 12 + 1) for i in range(3, n)])
    ridge = math.sqrt(reg.RIDGE * len(x)) * np.eye(10)
    coef = np.linalg.lstsq(np.vstack([x, ridge]), np.array(v[3:] + [0.0] * 10), rcond=None)[0]
    sigma = max(1.0, float(np.std((np.array(v[3:]) - x @ coef) * scale)))
    for i in range(n, n + steps):
        v.append(max(0.0, float(np.dot(coef, features(v, i, n, (first + i - 1) % 12 + 1)))))
    return coef, [a * scale for a in v[n:]], sigma


def months(n, year=2019):
    return [datetime.date(year + k // 12, k % 12 + 1, 1) for k in range(n)]


def made(seed):
    rng, out = random.Random(seed), {}
    for name, n in (("long", 60), ("short", 16), ("too short", 14), ("zeros", 30), ("falling", 40), ("constant", 30)):
        out[name] = [(d, {"zeros": 0.0, "constant": 7.0}.get(name, max(0.0, 50 + rng.gauss(0, 9) + 20 * math.sin(i / 2) - (3 * i if name == "falling" else 0)))) for i, d in enumerate(months(n))]
    return out


def check(got, by, steps):
    found = {}
    for r in got:
        found.setdefault(r.k, {})[r.step] = (r.yhat, r.sigma)
    for k, rows in by.items():
        want = plain(rows, steps)
        if want is None:
            assert k not in found
            continue
        assert [found[k][s][0] for s in range(1, steps + 1)] == pytest.approx(want[1], rel=1e-5, abs=1e-4), k
        assert found[k][1][1] == pytest.approx(want[2], rel=1e-5)


def test_made_series(spark):
    by = made(1)
    df = spark.createDataFrame([(k, d, y) for k, rows in by.items() for d, y in rows], "k string, date date, y double").repartition(3)
    got = reg.forecast(df, ["k"], 8).collect()
    check(got, by, 8)
    assert min(r.date for r in got if r.k == "short") == datetime.date(2020, 5, 1)
    assert {r.k: r.reason for r in reg.unfit(df, ["k"]).collect()} == {"too short": "only 14 months of 15", "zeros": "no sales"}
    assert reg.forecast(df.where("1 = 0"), ["k"], 3).collect() == [] == reg.backtest(df.where("1 = 0"), ["k"]).collect()


def test_registered_series(spark):
    by = {}
    for r in monthly_parts(spark, DATA).collect():
        by.setdefault(r.k, []).append((r.date, float(r.y)))
    assert len(by) > 100
    got = demand.QUERIES["regression_forecast"](spark, DATA).collect()
    some = dict(sorted(by.items())[::4])
    check([r for r in got if r.k in some], some, 6)


def test_backtest_is_a_fit_on_each_past(spark):
    by = {k: v for k, v in made(2).items() if k in ("long", "falling", "too short")}
    df = spark.createDataFrame([(k, d, y) for k, rows in by.items() for d, y in rows], "k string, date date, y double")
    got = {(r.k, r.fold, r.i): (r.y, r.yhat) for r in reg.backtest(df, ["k"]).collect()}
    want = {}
    for k, rows in by.items():
        n, test = len(rows), len(rows) // 4
        for fold in (1, 2, 3):
            origin = n - (4 - fold) * test
            if fitted := plain(rows[:origin], test):
                want |= {(k, fold, origin + j): (rows[origin + j][1], fitted[1][j]) for j in range(test)}
    assert got.keys() == want.keys()
    for key, (y, yhat) in want.items():
        assert got[key] == (y, pytest.approx(yhat, rel=1e-4, abs=1e-3))


def test_solved(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    for p in (1, 4, 10):
        a = rng.normal(size=(p + 5, p))
        m, b = a.T @ a, rng.normal(size=p)
        df = spark.createDataFrame([([[*r, y] for r, y in zip(m.tolist(), b.tolist(), strict=True)],)], "m array<array<double>>")
        assert df.select(reg.solved(F.col("m"), p).alias("s")).first().s == pytest.approx(np.linalg.solve(m, b).tolist())
