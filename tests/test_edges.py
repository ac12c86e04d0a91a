"""Edge cases of the operators on small inline tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from quaywise.functions import calendar, scalar
from quaywise.operators import anomaly, forecast, inventory, promo, retrieval, series
from quaywise.sources import files, sinks
from quaywise.streaming import events

D = dt.date


def frame(spark, values, key="a", unit="month"):
    rows = [(key, D(2020 + i // 12, i % 12 + 1, 1) if unit == "month" else D(2020, 1, 1) + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "k string, date date, y double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("2.7", "202603", " Yes "), ("nan", "3/2026", "no"), ("", "2026-03", None), (None, "2026-03-09", "ON"), ("-3.9", "x", "1"), ("1e3", "2026-13", "")], "n string, m string, b string")
    got = df.select(scalar.safe_int(F.col("n")), scalar.safe_float(F.col("n")), scalar.year_month(F.col("m")), scalar.safe_bool(F.col("b"))).collect()
    march = D(2026, 3, 1)
    assert [tuple(r) for r in got] == [(2, 2.7, march, True), (None, None, march, False), (None, None, march, False), (None, None, march, True), (-3, -3.9, None, True), (1000, 1000.0, None, False)]
    text = spark.createDataFrame([("Élan-Fibre  FTTH", "21612345678", "minus -12.5 % now"), ("2161234567", "1234567", "none"), (None, None, None)], "a string, b string, c string")
    got = text.select(scalar.normalised(F.col("a")), scalar.service_of(F.col("a")), scalar.valid_msisdn(F.col("b")), scalar.percent_in(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("elan fibre ftth", "FIBRE", True, -0.125), ("2161234567", "UNKNOWN", False, None), (None, "UNKNOWN", False, None)]
    assert abs(scalar.inverse_normal(0.95) - 1.6448536) < 1e-6


def test_calendar(spark):
    rows = {r.date: r for r in calendar.describe(calendar.dates(spark, "2025-02-27", "2025-03-20")).collect()}
    assert len(rows) == 22 and rows[D(2025, 3, 2)].dow == 0 and rows[D(2025, 3, 20)].is_holiday and rows[D(2025, 3, 1)].is_ramadan and not rows[D(2025, 2, 28)].is_ramadan


def test_gap_fill_counts_a_missing_month_as_zero(spark):
    got = series.gap_filled(frame(spark, [5, "gap", 7]), ["k"], "y", "month")
    assert column(got, "y") == [5, 0, 7]
    assert series.gap_filled(frame(spark, [5]).where("1=0"), ["k"], "y").collect() == []


def test_lags_and_interpolation(spark):
    thirteen = series.lags(frame(spark, range(10, 23)), ["k"], "y")
    assert column(thirteen, "lag_12")[-1] == 10
    got = series.filled(frame(spark, [None, 2, None, None, 8, None]), ["k"], "y")
    assert column(got, "filled") == [2, 2, 2, 2, 8, 8] and column(got, "interpolated") == [2, 2, 4, 6, 8, 8]
    assert column(series.filled(frame(spark, [None, None]), ["k"], "y"), "filled") == [0, 0]


def test_trim_smoothing_and_normalisation(spark):
    assert len(column(series.trailing_zeros_cut(frame(spark, [1, 0, 0, 0, 0, 0, 0, 0]), ["k"], "y"), "y")) == 6
    assert len(column(series.trailing_zeros_cut(frame(spark, [0] * 3), ["k"], "y"), "y")) == 3
    assert column(series.outliers_smoothed(frame(spark, [1, 2, 100, 2, 1, 2, 1]), ["k"], "y"), "smoothed") == [1, 2, 2, 2, 1, 2, 1]
    assert column(series.outliers_smoothed(frame(spark, [1, 1, 100]), ["k"], "y"), "smoothed") == [1, 1, 100]
    assert column(series.z_normalised(frame(spark, [3, 3, 3]), ["k"], "y"), "z") == [0, 0, 0]
    one = frame(spark, [4]).withColumn("m", series.neighbour_mean("y", ["k"]))
    assert column(one, "m") == [4]


def test_forecasts(spark):
    s = frame(spark, range(10, 22))
    assert column(forecast.seasonal_naive(s, ["k"], "y", 6), "yhat", "step") == [10, 11, 12, 13, 14, 15]
    short = forecast.seasonal_naive(frame(spark, [1, 2, 3]), ["k"], "y", 2)
    assert column(short, "yhat", "step") == [3, 3] and column(short, "date", "step") == [D(2020, 4, 1), D(2020, 5, 1)]
    band = forecast.banded(forecast.naive_last(s, ["k"], "y", 4), forecast.sigma(s, ["k"], "y"), ["k"])
    assert column(band, "upper", "step") == pytest.approx([21 + 1.28 * h**0.5 for h in range(1, 5)])
    got = {r.model: r.yhat for r in forecast.fitted(frame(spark, [10 + 2 * i for i in range(40)]), ["k"], "y", 1).collect()}
    assert got["holt"] == pytest.approx(90, abs=2) and got["linear_regression"] == pytest.approx(90, abs=2)
    one = forecast.fitted(frame(spark, [5]), ["k"], "y", 2).collect()
    assert len(one) == 10 and {(r.model, r.step) for r in one} == {(m, s) for m in forecast.FITTED for s in (1, 2)}  # five models, two steps
    assert all(0 <= r.yhat <= 5.01 for r in one) and {r.yhat for r in one if r.model in ("holt", "seasonal_arima")} == {5.0}


def test_errors_at_zero(spark):
    pairs = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.0, 2.0), ("a", 4.0, 4.0)], "k string, y double, yhat double")
    r = forecast.measured(pairs, ["k"]).first()
    assert r.mape == pytest.approx(100 * (1 + 1 + 0) / 3) and r.smape == pytest.approx(100 * 2 / 3) and r.wape == pytest.approx(50)
    zero = forecast.measured(pairs.where("y = 0"), ["k"]).first()
    assert zero.wape == 0


def test_walk_forward_never_looks_ahead(spark):
    rows = forecast.walk_forward(frame(spark, range(40)), ["k"], "y").collect()
    assert {r.fold for r in rows} == {1, 2, 3} and all(r.yhat < r.y for r in rows)
    assert forecast.walk_forward(frame(spark, [1, 2]), ["k"], "y").collect() == []


def test_anomalies(spark):
    assert anomaly.scored(frame(spark, [1, 50]), ["k"], "y").collect() == []
    assert anomaly.scored(frame(spark, [7] * 20), ["k"], "y").collect() == []
    got = anomaly.scored(frame(spark, [5] * 10 + [0] + [5] * 10), ["k"], "y").collect()
    assert [(r.anomaly_type, r.score, r.severity, r.variance_pct) for r in got] == [(anomaly.DATA_QUALITY, 0.9, "high", -100.0)]
    spike = anomaly.scored(frame(spark, [90] + [5] * 20), ["k"], "y").collect()
    assert [(r.anomaly_type, r.expected) for r in spike] == [(anomaly.SPIKE, 5.0)]
    x = np.concatenate([np.random.default_rng(1).normal(size=(200, 2)), [[9, 9]]])
    assert anomaly.forest_scores(x).argmax() == 200
    a = spark.createDataFrame([("a", D(2020, 1, 1), 0.5, "stat"), ("a", D(2020, 1, 2), 0.9, "stat")], "k string, date date, score double, method string")
    b = spark.createDataFrame([("a", D(2020, 1, 1), 0.7, "forest"), ("a", D(2020, 1, 2), 0.9, "forest"), ("a", D(2020, 1, 3), 0.6, "forest")], a.schema)
    assert column(anomaly.merged(a, b, ["k"]), "method") == ["combined", "stat", "forest"]


def test_nearest_event_stays_in_its_year(spark):
    df = spark.createDataFrame([(D(2025, 12, 30),), (D(2025, 1, 5),), (D(2025, 7, 1),), (D(2025, 3, 25),)], "date date")
    got = [(r.event, r.event_days) for r in anomaly.nearest_event(df, calendar.NEAREST_DAYS).orderBy("date").collect()]
    assert got == [("Jour de l'An", 4), ("Fête de l'Indépendance", 5), (None, None), (None, None)]  # of two equally near ones the first listed


SEGMENT = "product_family string, product_type string, governorate string, current_stock long, avg_monthly_demand double, forecast_series array<double>, stock_min int, stock_max int, real_months int, simulated_months int"


def segment(**given):
    base = {"product_family": "F", "product_type": "OTHER", "governorate": "A", "current_stock": 0, "avg_monthly_demand": 10.0, "forecast_series": [10.0] * 6, "stock_min": None, "stock_max": None, "real_months": None, "simulated_months": None}
    return tuple((base | given).values())


def one(spark, **given):
    return inventory.recommended(spark.createDataFrame([segment(**given)], SEGMENT)).first()


def test_risks_and_urgency(spark):
    point = one(spark).reorder_point
    assert point == 11  # ten a month for a month, and ceil(1.65 * 0.1)
    rows = [segment(current_stock=s) for s in (point, point + 1, 16, 17, 22, 23)]
    got = inventory.recommended(spark.createDataFrame(rows, SEGMENT)).orderBy("current_stock").collect()
    assert [r.rupture_risk for r in got] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
    assert [r.urgency for r in got] == ["IMMEDIATE", "THIS_WEEK", "THIS_WEEK", "THIS_MONTH", "THIS_MONTH", "THIS_MONTH"]
    calm = one(spark, current_stock=100)
    assert (calm.urgency, calm.order_qty, calm.overstock_risk) == ("NO_ACTION", 0, "MEDIUM") and one(spark, current_stock=122).overstock_risk == "HIGH"
    assert one(spark, current_stock=5, stock_max=0).overstock_risk == "LOW"


def test_recommendation_of_one_segment(spark):
    r = one(spark, product_type="CPE_HARDWARE", forecast_series=[10.0, 12.0, 14.5])
    std = ((0 + 4 + 4.5**2) / 2) ** 0.5
    safety = -(-1.65 * std * 2**0.5 // 1)
    assert (r.safety_stock, r.target_stock, r.order_qty % 5, r.demand_trend, r.reorder_point) == (safety, 36 + safety, 0, "INCREASING", 20 + safety)
    assert one(spark, forecast_series=[1.9, 1.0, 1.99]).demand_trend == "STABLE"  # whole units are compared
    none = one(spark, avg_monthly_demand=0.0, forecast_series=[0.0])
    assert (none.coverage_months, none.days_of_supply, none.demand_std, none.demand_trend) == (999, 999, 0.1, "STABLE")
    assert [one(spark, real_months=a, simulated_months=b).forecast_confidence for a, b in ((0, 0), (8, 2), (4, 6), (3, 7))] == ["LOW", "HIGH", "MEDIUM", "LOW"]
    assert [one(spark, real_months=a, simulated_months=b).data_source for a, b in ((0, 0), (8, 0), (0, 6), (3, 7))] == ["UNKNOWN", "REAL", "SIMULATED", "MIXED"]
    low = one(spark, stock_min=50)
    assert (low.safety_stock, low.reorder_point, low.target_stock) == (50, 60, 61)  # the target keeps the safety stock from before
    assert one(spark, current_stock=30, stock_max=40).order_qty == 10 and one(spark, current_stock=50, stock_max=40).order_qty == 0


def test_transfers(spark):
    rows = [segment(governorate="A"), segment(governorate="B", current_stock=60), segment(governorate="C", current_stock=90), segment(governorate="NATIONAL", current_stock=900), segment(governorate="D", product_type="X"), segment(governorate="C", product_family="G")]
    got = {(r.product_family, r.governorate): (r.suggestion, r.donor, r.excess, r.transfer_qty) for r in inventory.transfers(inventory.recommended(spark.createDataFrame(rows, SEGMENT))).collect()}
    assert got == {("F", "A"): ("TRANSFERT", "C", 79, 61), ("F", "D"): ("SUBSTITUTION", None, None, None), ("G", "C"): ("TRANSFERT", "B", 49, 49)}
    with pytest.raises(ValueError):
        inventory.z_of(0.93)
    assert inventory.z_of(0.93, strict=False) == 1.65 and inventory.nearest_level(0.96) == 0.95


def test_stock_of_a_segment_is_that_at_its_familys_last_date(spark):
    rows = [("F", "T", "A", D(2025, 1, 1), 5, 3, 1), ("F", "T", "A", D(2025, 2, 1), 7, 4, 1), ("F", "T", "B", D(2025, 1, 1), 9, 2, 2)]
    facts = spark.createDataFrame(rows, "product_family string, product_type string, governorate string, date date, stock_qty int, sales_qty int, activations_qty int")
    got = {r.governorate: (r.avg_monthly_demand, r.current_stock, r.stock_date) for r in inventory.demand_segments(facts).collect()}
    assert got == {"A": (4.5, 7, D(2025, 2, 1)), "B": (4.0, 0, None)}


def test_promotions(spark):
    days = [("x", D(2025, 12, 20), D(2026, 1, 20)), ("y", D(2025, 10, 20), D(2025, 10, 25)), ("r", D(2024, 2, 25), D(2024, 3, 1)), ("f", D(2024, 4, 1), D(2024, 4, 12)), ("a", D(2024, 6, 10), D(2024, 6, 20)), ("j", D(2025, 1, 25), D(2025, 1, 30))]
    p = spark.createDataFrame(days, "promo_id string, promo_start date, promo_end date")
    assert {r.promo_id: r.event for r in promo.tagged(p).collect()} == {"x": "nouvel_an", "y": None, "r": None, "f": "eid_fitr", "a": "eid_adha", "j": "revolution"}
    assert {r.promo_id: r.event for r in promo.tagged(p, every_year=True).collect()}["x"] == "revolution"
    assert {r.promo_id: r.event for r in promo.tagged(p, lead_days=0).collect()}["j"] is None
    e = promo.elasticity(spark.createDataFrame([(2.0,), (10.0,), (20.0,), (30.0,), (80.0,)], "d double"), "d")
    assert column(e, "expected_uplift", "d") == [10, 10, 20, 30, 45]
    own = promo.elasticity(spark.createDataFrame([(10.0, "5g"), (15.0, "VOD"), (60.0, "VOD")], "d double, s string"), "d", F.col("s"))
    assert column(own, "post_dip", "d") == [0.12, 0.25, 0.35]
    rows = spark.createDataFrame([("s", D(2025, 1, 31)), ("s", D(2025, 3, 1)), ("t", D(2025, 2, 1))], "service_code string, sale_date date")
    promos = spark.createDataFrame([("s", "p2", D(2025, 1, 20), D(2025, 2, 2)), ("s", "p1", D(2025, 1, 25), D(2025, 3, 1))], "service_code string, promo_code string, promo_start date, promo_end date")
    assert {(r.service_code, r.sale_date.month): r.promo_code for r in promo.first_active(rows, promos).collect()} == {("s", 1): "p2", ("s", 3): "p1", ("t", 2): None}


def test_uplift_ladder_takes_the_strictest_level_with_two(spark):
    past = [("V", "N", "web", "ramadan", D(2024, 3, 1), 10.0, 30.0), ("V", "N", "tv", "ramadan", D(2024, 3, 5), 12.0, 20.0), ("V", "S", "web", None, D(2024, 12, 5), 9.0, 8.0), ("V", "S", "web", None, D(2024, 11, 5), 30.0, 99.0)]
    history = spark.createDataFrame(past, "service_type string, region string, channel string, event_type string, promo_start date, discount_percent double, actual_uplift double")
    asked = [("a", "V", "N", "web", "ramadan", 3, 10.0), ("b", "V", None, None, None, 1, 10.0), ("c", "V", "S", None, None, 12, 10.0), ("d", "V", None, None, None, 12, 40.0)]
    q = spark.createDataFrame(asked, "question string, service_type string, region string, channel string, event_type string, month int, discount double")
    got = {r.question: (r.level, r.matches, r.uplift) for r in promo.uplift_ladder(history, q).collect()}
    assert got["a"] == (2, 2, 25.0) and got["b"] == (7, 3, pytest.approx(58 / 3)) and got["c"] == (7, 3, pytest.approx(58 / 3)) and "d" not in got


def test_retrieval(spark):
    assert retrieval.blocks_of("1. Intro\n\nSome  text\nhere\n\nEND:") == ["1. Intro\nSome text here", "END:"]
    docs = spark.createDataFrame([(1, "s", " ".join(f"w{i}" for i in range(700))), (2, "s", ""), (3, "s", None)], "doc_id long, source string, text string")
    got = retrieval.chunked(docs).collect()
    # a piece of 320 words fills a chunk, the next begins with the last 64 of it, and pieces that don't fit beside these go on alone
    assert [len(r.chunk.split()) for r in got] == [320, 64, 384, 124] and got[1].chunk.split()[0] == "w256"
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    asked = vectors.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert [r.vec_id for r in retrieval.dense_topk(vectors, asked, 5).orderBy("rank").collect()] == [1, 3]
    lists = spark.createDataFrame([(1, 7, 1)], "query_id long, doc_id long, rank int")
    assert retrieval.fused(lists, lists.where("1=0")).first().fused == pytest.approx(0.6 / 61)


def test_uploads(spark, tmp_path):
    path = tmp_path / "up.csv"
    lines = ["2026-01;P;10;10;2026-01-05", "2026-01;P;14;14;2026-01-25", "2026-01;P;15;100;2026-01-28", "202602;P;;20;2026-02-03"]
    path.write_text("\ufeffYear-Month;Product ID;current.stock_qty;STOCK_QTY;Stock Start/Of_Period\n" + "\n".join(lines) + "\n", encoding="utf-8")
    df = files.read_table(spark, str(path))
    assert df.columns == ["YEAR_MONTH", "PRODUCT_ID", "CURRENT_STOCK_QTY", "STOCK_QTY", "STOCK_START_OF_PERIOD", files.LINE] and files.kind_of(df.columns) == "stock"
    for some in (df, df.drop("STOCK_START_OF_PERIOD")):  # the last line of a month that is consistent, by day or by line
        got = files.stock_frame(some).orderBy("period").collect()
        assert [(r.period, r.quantity) for r in got] == [(D(2026, 1, 1), 14), (D(2026, 2, 1), 20)]
    kinds = {"MSISDN DATE": "sales", "PROMO_CODE MSISDN": "promotion", "COD_PROD QTE_STK YEAR_MONTH GOVERNORATE": "stock_5g", "COD_PROD YEAR_MONTH GOVERNORATE": "sales", "WAREHOUSE": "stock", "DATE CURRENT_STOCK SKU": "sales"}
    assert {c: files.kind_of(c.split()) for c in kinds} == kinds
    with pytest.raises(ValueError):
        files.read_table(spark, "x.pdf")
    five = spark.createDataFrame([("A", "2026-01", "Tunis", "-5", "3", "5G"), ("A", "2026-01", "Tunis", "8", "3", "5G"), ("A", "01/2026", "Tunis", "8", "3", "5G"), ("", "2026-01", "Tunis", "8", "3", None)], "COD_PROD string, YEAR_MONTH string, GOVERNORATE string, QTE_STK string, QTE_VTE string, FLAG_5G string").coalesce(1)
    assert files.kind_of(five.columns) == "stock_5g"
    assert [(r.stock, r.activations) for r in files.stock_5g_frame(five).collect()] == [(8, 0)]


def test_writes(spark):
    now = spark.createDataFrame([(1, "a", "x", 1), (None, "n", "n", 1)], "k int, keep string, swap string, seq int")
    new = spark.createDataFrame([(1, "b", "y", 2), (1, "c", "z", 3), (None, "m", "m", 2), (2, "d", "w", 1)], now.schema)
    got = sorted(((r.k, r.keep, r.swap) for r in sinks.upserted(now, new, ["k"], ["swap"]).collect()), key=repr)
    assert got == [(1, "a", "z"), (2, "d", "w"), (None, "m", "m"), (None, "n", "n")]
    dim = sinks.dimension_merged(now.select("k", "keep").where("k = 1"), spark.createDataFrame([(1, None), (3, "q")], "k int, keep string"), "k")
    assert sorted(map(tuple, dim.collect())) == [(1, "a"), (3, "q")]
    old = spark.createDataFrame([(dt.datetime(2025, 1, 1),), (dt.datetime(2025, 1, 9),)], "t timestamp")
    assert sinks.retained(old, "t", F.lit("2025-01-10").cast("timestamp"), 5).count() == 1


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    source = events.stream(spark, "/root/testdata/sf0.001")
    rows = events.daily(events.once(source), late=None)
    q = rows.writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.daily(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    key = lambda df: {(r.date, r.event_type, r.n) for r in df.collect()}
    got, want = key(spark.table("daily")), key(batch)
    last = max(d for d, _, _ in want)
    assert got <= want and {r for r in want if (last - r[0]).days > 2} <= got  # days within the watermark are still open


def test_fitted_models_follow_a_season():
    y = np.array([100 + i + 20 * np.sin(i * np.pi / 6) for i in range(72)])
    want = np.array([100 + i + 20 * np.sin(i * np.pi / 6) for i in range(72, 78)])
    for name, off in (("changepoint_trend", 3), ("seasonal_arima", 1), ("linear_regression", 5), ("boosted_stumps", 25)):
        assert np.abs(forecast.FITTED[name](y, 1, 6) - want).max() < off, name
    for name in forecast.FITTED:
        assert len(forecast.FITTED[name](np.array([5.0]), 1, 2)) == 2, name


def test_robust_decomposition_leaves_the_outlier_in_the_residual():
    y = np.array([50 + i + 10 * np.sin(i * np.pi / 6) for i in range(60)])
    y[30] += 80
    r = anomaly.stl_residual(y, 12)
    assert np.abs(r).argmax() == 30 and r[30] > 60 and np.median(np.abs(r)) < 2
    assert list(anomaly.stl_residual(np.array([1.0, 2.0]), 12)) == [1, 2]


def test_payloads(spark):
    from quaywise.functions import payloads

    assert payloads.json_in('so: ```json\n{"uplift": 5}\n``` ok') == {"uplift": 5}
    assert payloads.json_in('x {"a": [1, 2]} y') == {"a": [1, 2]} and payloads.json_in("uplift = 12.5 %", "uplift") == {"uplift": 12.5}
    assert payloads.json_in("nothing") is None and payloads.json_in(None) is None
    assert payloads.numbers_in({"results": [{"prediction": 1}, {"prediction": "x", "value": 2}]}) == [1.0, 2.0]
    df = spark.createDataFrame([("[1, 2.5]",), ('{"forecast": [3, 4, 5]}',), (None,), ("7",)], "t string").coalesce(1)
    got = df.select(payloads.series_in("t").alias("x")).select(payloads.of_length(F.col("x"), 3).alias("s")).collect()
    assert [r.s for r in got] == [[1, 2.5, 4.0], [3, 4, 5], None, None]
    names = spark.createDataFrame([("ben  arus",), ("xyz",), (None,), ("TUNIS",)], "t string")
    members = spark.createDataFrame([("Ben Arous",), ("Tunis",)], "m string")
    assert {r.t: r.m for r in payloads.nearest(names, "t", members, "m").collect()} == {"ben  arus": "Ben Arous", "xyz": None, None: None, "TUNIS": "Tunis"}


def test_sales_upload(spark):
    schema = "CREATION_DATE string, MSISDN string, OFFRE string, SERVICE_TYPE string, POINT_VENTE string"
    rows = [("31/12/2025", "21612345678", "Fibre 100", None, "D1"), ("31/12/2025", "2161234567", "Fibre 100", None, "D1"), ("01/01/2026", "12345678", "x", "vod", "D2"), ("01/01/2026", "12345678", "autre", None, "D2"), ("?", "12345678", "5G", None, "D2"), ("31/12/2025", "21612345678", "Fibre 200", None, "D9")]
    up = spark.createDataFrame(rows, schema).coalesce(1)
    got = files.sales_frame(up)
    assert sorted((r.created_at.date(), r.service_code, r.dealer_id) for r in got.collect()) == [(D(2025, 12, 31), "FIBRE", "D1"), (D(2025, 12, 31), "FIBRE", "D9"), (D(2026, 1, 1), "VOD", "D2")]
    facts = sinks.upserted(got.limit(0), got, sinks.SALES_KEY, ["dealer_id", "offre_code"], "line").where("service_code = 'FIBRE'").first()
    assert (facts.dealer_id, facts.product_id) == ("D9", "Fibre 100")  # the dealer of the last row, the product of the first
    assert files.main_service(up).first().service == "FIBRE" and files.period(up).first()[:] == (D(2025, 12, 31), D(2026, 1, 1)) and files.previewed(up).count() == 5
    with pytest.raises(ValueError):
        files.sales_frame(up.drop("CREATION_DATE"))


def test_dimensions_of_uploads(spark):
    none = spark.createDataFrame([], "geo_id long, city string, governorate string, delegation string")
    rows = spark.createDataFrame([(None, "Tunis", None), (None, "tunis ", None), ("X", None, "d"), (None, None, "z")], "city string, governorate string, delegation string")
    geo = sinks.geo_ensured(sinks.geo_ensured(none, rows), rows)
    assert geo.count() == 2
    named, places = sinks.governorates_resolved(spark.createDataFrame([(" TUNIS",), ("Sfax",), ("",)], "governorate string"), geo)
    assert named.select("geo_id").distinct().count() == 3 and places.count() == 4
    schema = "PROMO_CODE string, PROMO_NAME string, PROMO_TYPE string, DISCOUNT_PCT string, PROMO_START string, PROMO_END string"
    up = spark.createDataFrame([("a", None, None, "12", "2026-01-05", "bad"), ("b", "B", "gift", "", None, None)], schema)
    empty = spark.createDataFrame([], "promo_code string, promo_name string, promo_type string, discount_pct double, promo_start date, promo_end date")
    got = sorted(map(tuple, sinks.promos_ensured(empty, up, F.lit("2026-02-01").cast("date")).collect()))
    assert got == [("a", "a", "discount", 12.0, D(2026, 1, 5), D(2026, 1, 5)), ("b", "B", "gift", None, D(2026, 2, 1), D(2026, 2, 1))]
    facts = spark.createDataFrame([("f1", D(2026, 1, 1)), ("f1", D(2026, 1, 3))], "source_file string, date date")
    assert tuple(sinks.already_loaded(facts, "f1").first()) == (2, D(2026, 1, 1), D(2026, 1, 3)) and sinks.already_loaded(facts, "f2").count() == 0
    assert sinks.loaded(facts, facts.limit(1), "f1").count() == 2 and sinks.loaded(facts, facts.limit(1), "f1", replace=True).count() == 1


def test_horizons_and_holdouts():
    assert [forecast.holdout_size(n, h, u) for n, h, u in ((2, 6, "month"), (40, 6, "month"), (40, 1, "month"), (4, 6, "day"), (40, 6, "day"))] == [1, 6, 3, 3, 7]
    assert forecast.horizon_of(45, "day") == 6 and forecast.horizon_of(45, "month") == 12 and forecast.available() == []
