import datetime
import hashlib
import math

from pyspark.sql import functions as F
from quaywise.operators import replenishment

SCHEMA = "k string, p string, month date, sold double, activations double, on_hand double"


def day(m):
    return datetime.date(m // 12, m % 12 + 1, 1)


def series(k, p, start, sold, ratio=0.5, stock=40.0):
    return [(k, p, day(start + i), None if s is None else float(s), None if s is None else s * ratio, stock + i) for i, s in enumerate(sold)]


ROWS = [
    *series("a", "x", 2022 * 12 + 2, [20 + i + 5 * (i % 12 == 3) for i in range(30)]),
    *series("a", "y", 2023 * 12 + 11, [900 - 30 * i for i in range(14)], 0.9, 5000.0),  # falling: more was sold before
    *series("b", "x", 2024 * 12, [7.0]),  # one month
    *series("b", "y", 2024 * 12, [0.0, None, 0.0]),  # nothing sold
    *series(None, "x", 2021 * 12 + 5, [3.0, None, 500.0, 2.0]),
    ("gap", None, day(2020 * 12), 10.0, 10.0, None),
    ("gap", None, day(2021 * 12 + 6), 90.0, None, 1.0),
]


def plain(rows, months):
    whole = lambda x: math.floor(x + 0.5)
    out = []
    for k, p in {r[:2] for r in rows}:
        mine = sorted(r for r in rows if r[:2] == (k, p))
        at = [r[2].year * 12 + r[2].month - 1 for r in mine]
        y, a = [r[3] or 0.0 for r in mine], [r[4] or 0.0 for r in mine]
        mean, centre = sum(y) / len(y), sum(at) / len(at)
        spread = sum((t - centre) ** 2 for t in at)
        slope = sum((t - centre) * (v - mean) for t, v in zip(at, y, strict=True)) / spread if spread else 0.0
        base, ratio = mean - slope * (centre - at[0]), sum(a) / sum(y) if sum(y) else 0.82
        stock = max(10.0, (mine[0][5] or 0.0) * max(0.3, 1 - slope * months / max(base, 1.0)))
        for t in range(at[0] - months, at[0]):
            u = lambda what: int(hashlib.md5(f"{what}|{day(t):%Y-%m}|{k or ''}|{p or ''}".encode()).hexdigest()[:8], 16) / 2**32  # noqa: E731, B023
            noisy = lambda x, what, rel: whole(x * (1 + rel * (2 * u(what) - 1)))  # noqa: E731, B023
            same = [v for m, v in zip(at, y, strict=True) if m % 12 == t % 12]
            season = sum(same) / len(same) / mean if same and mean > 0 else 1.0
            usual = max(1.0, (base - slope * (at[0] - t)) * season)
            sold = max(1.0, noisy(usual, "sold", 0.08))
            received = whole(usual * (3.5 + 1.5 * u("fill"))) if stock < 2 * usual else 0
            opening = stock + received
            stock = max(0.0, opening - sold)
            out.append((k, p, day(t), sold, noisy(sold * ratio, "activations", 0.05), noisy(sold * 0.12, "reserved", 0.1), received, stock, noisy(stock * 1.05, "counted", 0.05), noisy(opening, "opening", 0.03)))
    return sorted(out, key=repr)


def test_backcast_step_by_step(spark):
    rows = spark.createDataFrame(ROWS + [("c", "z", None, 1.0, 1.0, 1.0)], SCHEMA)
    found = replenishment.backcast(rows, ["k", "p"], 18)
    assert found.columns == ["k", "p", "month", "sold", "activations", "reserved", "received", "on_hand", "counted", "opening"]
    got, want = sorted((tuple(r) for r in found.collect()), key=repr), plain(ROWS, 18)
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) == 18 * 6
    for g, w in zip(got, want, strict=True):
        assert all(abs(x - v) < 1e-6 for x, v in zip(g[3:], w[3:], strict=True)), (g, w)
    assert {g[6] > 0 for g in got} == {True, False}


def test_ends(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    assert replenishment.backcast(rows.limit(0), ["k", "p"]).count() == 0
    assert replenishment.backcast(rows, ["k", "p"], 1).count() == 6
    one = replenishment.described(rows.where("k = 'b' AND p = 'x'"), ["k", "p"]).first()
    assert (one.slope, one.intercept, one.ratio, one.first_stock) == (0.0, 7.0, 0.5, 40.0) and one.season == [1.0] * 12
    numbers = [r[0] for r in spark.range(2000).select(replenishment.uniform("sold", F.lit(day(24288)), F.col("id").cast("string"))).collect()]
    assert 0 <= min(numbers) and max(numbers) < 1 and abs(sum(numbers) / 2000 - 0.5) < 0.03
