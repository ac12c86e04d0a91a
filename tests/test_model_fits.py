"""The queries of fitted models, which have no SQL, against second versions in plain Python."""

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from quaywise.operators import anomaly, forecast
from quaywise.plans import queries as demand

DATA = "/root/testdata/sf0.001"


def by_key(df):
    out = defaultdict(list)
    for r in df.orderBy("k", "date").collect():
        out[r.k].append((r.date, r.y))
    return out


@pytest.fixture(scope="module")
def regions(spark):
    return by_key(demand.regions(spark, DATA))


@pytest.fixture(scope="module")
def fitted(spark):
    return {(r.k, r.model, r.step): r.yhat for r in demand.fitted_forecast(spark, DATA).collect()}


def ridge(x, y, shrink):
    """Least squares with a row of its own for each shrunk weight."""
    return np.linalg.lstsq(np.vstack([x, np.diag(np.sqrt(shrink))]), np.concatenate([y, np.zeros(len(shrink))]), rcond=None)[0]


def plain_holt_errors(y):
    return [t[0] for t in plain_holt_fits(y)]


def plain_holt(y, steps):
    _, level, trend = min(plain_holt_fits(y), key=lambda t: t[0])
    return [max(0, level + trend * s) for s in range(1, steps + 1)]


def plain_holt_fits(y):
    tried = []
    for i in range(1, 10):
        for j in range(7):
            a, b = 0.1 * i, 0.05 + 0.15 * j
            levels, trends, missed = [y[0]], [y[1] - y[0]], []
            for v in y[1:]:
                missed.append(v - levels[-1] - trends[-1])
                levels.append(levels[-1] + trends[-1] + a * missed[-1])
                trends.append(trends[-1] + b * (levels[-1] - levels[-2] - trends[-1]))
            tried.append((sum(e * e for e in missed), levels[-1], trends[-1]))
    return tried


def plain_regression(y, month, steps):
    y, n = list(y), len(y)
    lags = [k for k in (1, 2, 3, 12) if 2 * k < n]
    for i in range(n, n + steps):
        turn = lambda j: 2 * math.pi * (month + j) / 12
        rows = [[1, j, math.sin(turn(j)), math.cos(turn(j)), *(y[j - k] for k in lags)] for j in range(max(lags), i + 1)]
        w = ridge(np.array(rows[:-1]), np.array(y[max(lags) : i]), [1e-3] * len(rows[0]))
        y.append(max(0, float(np.array(rows[-1]) @ w)))
    return y[n:]


def plain_changepoints(y, month, steps):
    n = len(y)
    count = min(8, max(n // 4, 1))
    bends = [0.8 * (i + 1) / (count + 1) for i in range(count)]
    order = [1, 2, 3] if n >= 24 else []

    def row(j):
        t = j / max(n - 1, 1)
        turn = 2 * math.pi * (month + j) / 12
        return [1, t, *(max(t - b, 0) for b in bends), *(math.sin(turn * o) for o in order), *(math.cos(turn * o) for o in order)]

    w = ridge(np.array([row(j) for j in range(n)]), np.array(y), [1e-6, 1e-3] + [1] * count + [1e-2] * (2 * len(order)))
    return [max(0, float(np.array(row(j)) @ w)) for j in range(n, n + steps)]


def plain_arima(y, steps, s=12):
    """By the products of the lag polynomials."""

    def both(one, two, sign):
        p, q = np.zeros(2), np.zeros(s + 1)
        p[0] = q[0] = 1
        p[1], q[s] = sign * one, sign * two
        return np.convolve(p, q)

    w = [y[i] - y[i - 1] - y[i - s] + y[i - s - 1] for i in range(s + 1, len(y))]

    def errors(p):
        ar, ma, e = both(p[0], p[2], -1), both(p[1], p[3], 1), []
        for i in range(len(w)):
            e.append(sum(ar[k] * w[i - k] for k in range(min(i, s + 1) + 1)) - sum(ma[k] * e[i - k] for k in range(1, min(i, s + 1) + 1)))
        return e

    p = [0.0] * 4
    for _ in range(3):
        for k in range(4):
            tried = [(sum(e * e for e in errors([*p[:k], v, *p[k + 1 :]])), v) for v in np.linspace(-0.9, 0.9, 13)]
            p[k] = min(tried, key=lambda t: t[0])[1]
    ar, ma, e, out = both(p[0], p[2], -1), both(p[1], p[3], 1), errors(p), list(y)
    for _ in range(steps):
        i = len(w)
        w.append(sum(ma[k] * e[i - k] for k in range(1, s + 2) if k <= i) - sum(ar[k] * w[i - k] for k in range(1, s + 2) if k <= i))
        e.append(0.0)
        out.append(w[-1] + out[-1] + out[-s] - out[-s - 1])
    return [max(0, v) for v in out[len(y) :]]


def plain_stumps(y, month, steps):
    y, n = list(y), len(y)
    lags = [k for k in (1, 2, 3, 12) if 2 * k < n]
    row = lambda j: [j, (month + j) % 12, *(y[j - k] for k in lags)]
    x, target = [row(j) for j in range(max(lags), n)], np.array(y[max(lags) :])
    splits = []
    for f in range(len(x[0])):
        for cut in sorted({float(np.quantile([r[f] for r in x], q)) for q in np.linspace(0.1, 0.9, 9)}):
            left = np.array([r[f] <= cut for r in x])
            if 0 < left.sum() < len(x):
                splits.append((f, cut, left))
    rest, trees = target - target.mean(), []
    for _ in range(150 if splits else 0):
        gains = [left.sum() * rest[left].mean() ** 2 + (~left).sum() * rest[~left].mean() ** 2 for _, _, left in splits]
        f, cut, left = splits[int(np.argmax(gains))]
        low, high = 0.1 * rest[left].mean(), 0.1 * rest[~left].mean()
        trees.append((f, cut, low, high))
        rest = rest - np.where(left, low, high)
    for j in range(n, n + steps):
        y.append(max(0, target.mean() + sum(low if row(j)[f] <= cut else high for f, cut, low, high in trees)))
    return y[n:]


PLAIN = {
    "holt": lambda y, m, h: plain_holt(y, h),
    "linear_regression": plain_regression,
    "changepoint_trend": plain_changepoints,
    "seasonal_arima": lambda y, m, h: plain_arima(y, h),
    "boosted_stumps": plain_stumps,
}


@pytest.mark.parametrize("model", sorted(PLAIN))
def test_forecasts_of_every_region(regions, fitted, model):
    assert set(PLAIN) == set(forecast.FITTED) and len(fitted) == len(regions) * len(PLAIN) * 6
    for k in sorted(regions)[:8]:
        y = [v for _, v in regions[k]]
        want = PLAIN[model](y, regions[k][0][0].month, 6)
        assert [fitted[k, model, s] for s in range(1, 7)] == pytest.approx(want, rel=1e-5, abs=1e-4), (k, model)


def test_bands(spark, regions):
    for r in demand.fitted_forecast(spark, DATA).where("step in (1, 4)").collect():
        y = [v for _, v in regions[r.k]]
        if r.model in ("changepoint_trend", "seasonal_arima"):
            d = [b - a for a, b in zip(y, y[1:])]
            sigma = math.sqrt(sum((v - sum(d) / len(d)) ** 2 for v in d) / len(d))
        elif r.model == "holt":
            sigma = math.sqrt(min(plain_holt_errors(y)) / (len(y) - 2))
        elif r.k in sorted(regions)[:3]:
            yhat = PLAIN[r.model](y[:-3], regions[r.k][0][0].month, 3)
            sigma = math.sqrt(sum((a - b) ** 2 for a, b in zip(y[-3:], yhat, strict=True)) / 3)
        else:
            continue
        wide = 1.28 * max(1, sigma) * (1 if r.step == 1 else 2)
        assert (r.lower, r.upper) == pytest.approx((max(0, r.yhat - wide), r.yhat + wide), rel=1e-5, abs=1e-4), (r.k, r.model)


def test_scores_and_ensemble(spark, regions, fitted):
    pairs = defaultdict(list)
    for r in forecast.backtested(demand.regions(spark, DATA), ["k"], "y").collect():
        pairs[r.k, r.model].append((r.fold, r.i, r.y, r.yhat))
    for (k, _), rows in pairs.items():  # the last three quarters, each predicted from what was before it
        n = len(regions[k])
        test = n // 4
        assert {(f, i) for f, i, _, _ in rows} == {(f, n - (4 - f) * test + j) for f in (1, 2, 3) for j in range(test)}
        assert all(y == regions[k][i][1] for _, i, y, _ in rows)
    k = min(regions)
    y = [v for _, v in regions[k]]
    test = len(y) // 4
    first = [p for f, _, _, p in sorted(pairs[k, "holt"]) if f == 1]
    assert first == pytest.approx(plain_holt(y[: len(y) - 3 * test], test), abs=1e-6)

    mape = {key: 100 * sum(abs((y or 1.0) - p) / abs(y or 1.0) for _, _, y, p in rows) / len(rows) for key, rows in pairs.items()}
    for r in demand.model_zoo_scores(spark, DATA).where("model not in ('naive_last', 'seasonal_naive')").collect():
        rows = [(y, p) for _, _, y, p in pairs[r.k, r.model]]
        bias = abs(sum(p - y for y, p in rows)) * 100 / max(len(rows), sum(y for y, _ in rows))
        assert r.mae == pytest.approx(sum(abs(p - y) for y, p in rows) / len(rows), abs=1e-5)
        assert r.wape == pytest.approx(100 * sum(abs(p - y) for y, p in rows) / sum(y for y, _ in rows), abs=1e-5)
        assert r.composite == pytest.approx(mape[r.k, r.model] + bias / 2, rel=1e-6)
    composite = {}
    for key, rows in pairs.items():
        composite[key] = mape[key] + abs(sum(p - y for _, _, y, p in rows)) * 50 / max(len(rows), sum(y for _, _, y, _ in rows))
    got = demand.weighted_ensemble(spark, DATA).collect()
    assert len(got) == 6 * len(regions)
    for r in got:
        best = sorted((composite[r.k, m], m) for m in PLAIN)[:3]
        want = sum(fitted[r.k, m, r.step] / s for s, m in best) / sum(1 / s for s, _ in best)
        assert r.members == 3 and r.yhat == pytest.approx(want, rel=1e-6, abs=1e-4)


def lines(y, weights, span):
    """Weighted straight lines by their normal equations."""
    out = []
    for i in range(len(y)):
        far = [abs(j - i) for j in range(len(y))]
        reach = sorted(far)[min(span, len(y)) - 1] + 1
        w = [max(1 - (f / reach) ** 3, 0) ** 3 * v + 1e-12 for f, v in zip(far, weights, strict=True)]
        s0, s1, s2 = (sum(a * (j - i) ** p for j, a in enumerate(w)) for p in (0, 1, 2))
        t0, t1 = (sum(a * b * (j - i) ** p for j, (a, b) in enumerate(zip(w, y, strict=True))) for p in (0, 1))
        det = s0 * s2 - s1 * s1
        out.append((t0 * s2 - t1 * s1) / det if det > 1e-9 * s0 * s0 else t0 / s0)
    return out


def plain_stl(y, period=12):
    n = len(y)
    if n < 2 * period + 1:
        return y
    trend, season, weights = [0.0] * n, [0.0] * n, [1.0] * n
    for _ in range(3):
        for phase in range(period):
            at = range(phase, n, period)
            for i, v in zip(at, lines([y[i] - trend[i] for i in at], [weights[i] for i in at], 7), strict=True):
                season[i] = v
        half = period // 2  # of an even number of months, the mean has one more of those before
        season = [s - sum(season[j % n] for j in range(i - half, i + half)) / period for i, s in enumerate(season)]
        trend = lines([a - b for a, b in zip(y, season, strict=True)], weights, int(1.5 * period) | 1)
        rest = [abs(a - b - c) for a, b, c in zip(y, trend, season, strict=True)]
        six = 6 * float(np.median(rest)) + 1e-12
        weights = [max(1 - (v / six) ** 2, 0) ** 2 for v in rest]
    return [a - b - c for a, b, c in zip(y, trend, season, strict=True)]


def test_robust_decomposition(spark):
    cells = demand.cells(spark, DATA)
    got = defaultdict(list)
    for r in anomaly.stl(cells, ["k"], "y").orderBy("k", "date").collect():
        got[r.k].append(r.residual)
    rows = by_key(cells)
    some = sorted(rows, key=lambda k: (-len(rows[k]), k))[:5] + sorted(rows, key=lambda k: (len(rows[k]), k))[:5]
    for k in some:
        assert got[k] == pytest.approx(plain_stl([v for _, v in rows[k]]), rel=1e-6, abs=1e-6)
    found = {(r.k, r.date): r for r in demand.stl_anomalies(spark, DATA).collect()}
    want = set()
    for k, series in rows.items():
        e = np.array(got[k])
        y = np.array([v for _, v in series])
        if len(e) >= 3:
            z = (e - e.mean()) / (e.std(ddof=1) or 1.0)
            want |= {(k, d) for (d, v), s in zip(series, z, strict=True) if abs(s) >= 2.5 or v == 0 and y.mean() > 0}
    assert set(found) == want and want


def grown(x, rng, own, depth, deep):
    """A tree as nested tuples; its greater side is grown first, as the order of random numbers wants it."""
    spread = np.array([x[own, f].max() - x[own, f].min() for f in range(x.shape[1])]) if len(own) else np.zeros(x.shape[1])
    if depth >= deep or len(own) < 2 or not spread.any():
        return len(own)
    f = rng.choice(np.flatnonzero(spread))
    cut = rng.uniform(x[own, f].min(), x[own, f].max())
    more = grown(x, rng, own[x[own, f] >= cut], depth + 1, deep)
    return f, cut, grown(x, rng, own[x[own, f] < cut], depth + 1, deep), more


def usual(m):
    return 2 * (math.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m if m > 2 else float(m == 2)


def plain_forest(x):
    rng, n = np.random.default_rng(42), len(x)
    size = min(256, n)
    total = np.zeros(n)
    for _ in range(100):
        tree = grown(x, rng, rng.choice(n, size, replace=False), 0, math.ceil(math.log2(size)))
        for i in range(n):
            node, depth = tree, 0
            while isinstance(node, tuple):
                node, depth = node[2] if x[i, node[0]] < node[1] else node[3], depth + 1
            total[i] += depth + usual(node)
    return 2 ** (-total / 100 / usual(size))


def test_isolation_forest(spark):
    from pyspark.sql import functions as F
    from quaywise.operators import marts

    sales = marts.sales(spark, DATA).groupBy(F.col("region_label").alias("k"), F.trunc("sale_date", "MM").alias("date")).agg(F.sum("qty").alias("y"), F.avg("price").alias("price"))
    frame = anomaly.decomposed(sales, ["k"], "y").toPandas()
    found = {(r.k, r.date): r.forest_score for r in demand.isolation_forest(spark, DATA).collect()}
    some = sorted(frame["k"].unique())[:3]
    for k in some:
        rows = frame[frame["k"] == k].sort_values("date", ignore_index=True)
        days = pd.to_datetime(rows["date"])
        x = np.column_stack([rows["y"], rows["price"], days.dt.month, days.dt.dayofyear, rows["residual"]]).astype(float)
        x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        score = anomaly.forest_scores(x)
        assert score == pytest.approx(plain_forest(x), rel=1e-9)
        scaled = (score - score.min()) / (score.max() - score.min())
        want = {d: v for d, v, raw in zip(rows["date"], scaled, score, strict=True) if v >= 0.55 and raw >= np.quantile(score, 0.92)}
        assert {d: v for (key, d), v in found.items() if key == k} == pytest.approx(want, abs=2e-6)


def test_synthetic_history(spark):
    stock = demand.stock(spark, DATA)
    demands = defaultdict(list)
    for r in stock.orderBy("month").collect():
        demands[r.product_category, r.region_label].append((r.month, r.sold))
    made = defaultdict(list)
    for r in demand.synthetic_history(spark, DATA).orderBy("month").collect():
        made[r.product_category, r.region_label].append(r)
    assert set(made) == set(demands)
    for key, rows in made.items():
        first, y = demands[key][0][0], [v for _, v in demands[key]]
        assert [r.month.year * 12 + r.month.month for r in rows] == [first.year * 12 + first.month - i for i in range(24, 0, -1)]
        mean = max(sum(y) / len(y), 0.01)
        slope = float(np.cov(range(len(y)), y, bias=True)[0, 1] / np.var(range(len(y)))) if len(y) > 1 else 0.0
        held = 2 * mean
        for i, r in zip(range(24, 0, -1), rows, strict=True):
            same = [v for m, v in demands[key] if m.month == r.month.month]
            usual_now = max(0.0, (mean - slope * (i + len(y) / 2)) * (sum(same) / len(same) if same else mean) / mean)
            assert abs(r.sold - usual_now) <= 6 * 0.05 * usual_now + 1e-5
            received = max(0.0, 2 * mean - held) if held - r.sold < mean else 0.0
            assert r.received == pytest.approx(received, abs=1e-4)
            held = max(0.0, held + received - r.sold)
            assert r.on_hand == pytest.approx(held, abs=1e-4)
