import datetime
import math

import pytest
from quaywise.operators import regression, stock_forecast

NAN = float("nan")


def months(k, values, start=2022 * 12):
    return [(k, datetime.date((start + i) // 12, (start + i) % 12 + 1, 1), None if v is None else float(v)) for i, v in enumerate(values)]


SERIES = [
    *months("long", [10 + i % 12 for i in range(26)]), *months("short", [5, 6, 7]), *months("one", [9]), *months("nulls", [1, None, 3, None]),
    *months("nan", [1, NAN, 2]), *months("endless", [float("inf"), 1]), *months(None, [1, 2, 3]), *months("late", range(12), 2023 * 12 + 6), *months("none", [0] * 20),
]


def frame(spark, rows=SERIES):
    return spark.createDataFrame(rows, "k string, date date, y double")


def test_bad_series_are_rows_and_the_others_are_forecast(spark):
    found = stock_forecast.pipeline(frame(spark), ["k"], "y", 3)
    assert found.columns == ["scope", "k", "step", "date", "yhat", "lower", "upper", "model", "downgraded_from", "reason"]
    rows = found.collect()
    assert {(r.k, r.reason) for r in rows if r.scope == "failed"} == {("one", "only 1 months of 2"), ("nulls", "2 values missing"), ("nan", "1 values missing"), ("endless", "1 values missing"), (None, "no name")}
    assert sum(r.scope == "failed" for r in rows) == 5
    each = {(r.k, r.step): r for r in rows if r.scope == "per_family"}
    assert {k for k, _ in each} == {"long", "short", "late", "none"} and len(each) == 12
    assert [each["long", s].yhat for s in (1, 2, 3)] == [12, 13, 14] and each["long", 1].model == "seasonal_naive" and each["long", 1].downgraded_from is None
    assert [each["short", s].yhat for s in (1, 2, 3)] == [7, 7, 7] and (each["short", 1].model, each["short", 1].downgraded_from) == ("naive_last", "seasonal_naive")
    assert (each["short", 2].lower, each["short", 2].upper) == (pytest.approx(7 - 1.28), pytest.approx(7 + 1.28))
    total = sorted((r for r in rows if r.scope == "global"), key=lambda r: r.step)
    want = {}
    for r in each.values():
        want[r.date] = want.get(r.date, 0) + r.yhat
    assert [(r.date, r.yhat) for r in total] == sorted(want.items()) and [r.step for r in total] == list(range(1, len(want) + 1)) and all(r.k is None for r in total)
    mean = sum(want.values()) / len(want)
    wide = 1.28 * max(1.0, math.sqrt(sum((v - mean) ** 2 for v in want.values()) / len(want)))
    assert [r.upper - r.yhat for r in total] == pytest.approx([wide] * len(total)) and all(r.lower == pytest.approx(max(0, r.yhat - wide)) for r in total)


def test_scopes_summary_and_empty(spark):
    kinds = lambda scope: {r.scope for r in stock_forecast.pipeline(frame(spark), ["k"], "y", 2, scope=scope).select("scope").collect()}
    assert kinds("global") == {"global", "failed"} and kinds("per_family") == {"per_family", "failed"}
    one = stock_forecast.summary(stock_forecast.pipeline(frame(spark), ["k"], "y", 2), frame(spark), ["k"], "y").first()
    # the last month of what is forecast is that of "late" alone (11), its last step comes last as well (1)
    assert (one.n_forecast, one.n_failed, one.partial_results, one.trend) == (4, 5, True, "baisse") and one.change_pct == pytest.approx(-1000 / 11)
    none = frame(spark, [])
    found = stock_forecast.pipeline(none, ["k"], "y", 2)
    assert found.count() == 0
    assert tuple(stock_forecast.summary(found, none, ["k"], "y").first()) == (0, 0, False, 0.0, "hausse")
    for wrong in ({"model": "lstm"}, {"scope": "all"}):
        with pytest.raises(ValueError, match="one of"):
            stock_forecast.pipeline(none, ["k"], "y", 2, **wrong)


def test_regression_takes_simpler_models_where_it_must(spark):
    rows = frame(spark, SERIES + months("mid", [4 + i for i in range(13)]))
    found = stock_forecast.pipeline(rows, ["k"], "y", 2, "linear_regression").collect()
    models = {r.k: (r.model, r.downgraded_from) for r in found if r.scope == "per_family"}
    assert models == {"long": ("linear_regression", None), "short": ("naive_last", "linear_regression"), "late": ("seasonal_naive", "linear_regression"), "mid": ("seasonal_naive", "linear_regression")}
    assert ("none", "no sales") in {(r.k, r.reason) for r in found if r.scope == "failed"}
    alone = {r.step: r.yhat for r in regression.forecast(rows.where("k = 'long'"), ["k"], 2).collect()}
    assert {r.step: r.yhat for r in found if r.k == "long"} == pytest.approx(alone)
