"""Functions that no registered query has a use for, by literal cases."""

import datetime
import math

import pytest
from pyspark.sql import functions as F
from quaywise.functions import scalar
from quaywise.operators import forecast, generators, numbering, promo, retrieval, series
from quaywise.sources import files, sinks

D = datetime.date


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_scalars(spark):
    assert one(spark, scalar.citation(F.lit("a.pdf"), F.lit(3), F.lit(7)), scalar.service_alias(F.lit("data")), scalar.service_alias(F.lit("fibre"))) == ("a.pdf#p3-c7", "DATA_BUNDLE", "FIBRE")
    a, b = (scalar.month_index(F.lit(D(y, m, 15))) for y, m in ((2024, 2), (2025, 1)))
    assert one(spark, b - a, a % 12) == (11, 2)


def test_models_of_short_histories(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 5, 8, 12, 40)], "n int")
    get = lambda m: [r[0] for r in rows.select(forecast.effective_model(m, F.col("n"))).collect()]
    assert get("prophet") == ["naive_last", "naive_last", "prophet", "prophet", "prophet"]
    assert forecast.effective_model("other", F.lit(0)) is not None and get("holt") == ["naive_last", "holt", "holt", "holt", "holt"]


def test_service_asked(spark):
    known = spark.createDataFrame([("FIBRE",), (" 5g ",), (None,)], "service_code string")
    ask = lambda a, d=None: forecast.service_asked(a, d, known)
    assert [ask("fibre"), ask(" 5G"), ask("all", "5G"), ask("*"), ask(None, "fibre"), ask("", "vod"), ask(None)] == ["FIBRE", "5G", None, None, "FIBRE", None, None]
    with pytest.raises(ValueError):
        ask("vod", "fibre")


def test_chunks_are_stored_once(spark):
    text = "\n\n".join(" ".join(f"w{i}x{k}" for k in range(200)) for i in range(3))
    docs = spark.createDataFrame([(2, "b.txt", "second", None, "txt"), (1, "b.txt", "first", None, "txt"), (3, "a.txt", text, "fibre", "txt"), (4, "c.txt", " ", None, "txt"), (5, "d.txt", None, None, "txt")], "doc_id long, source string, text string, service string, doc_type string")
    store = spark.createDataFrame([("a.txt", 0, "FIBRE", "old", "txt"), ("a.txt", 0, "MULTI", "kept", "txt"), ("z.txt", 0, "MULTI", "kept too", "txt")], "source string, chunk_index int, service string, chunk string, doc_type string")
    got = {(r.source, r.chunk_index, r.service): r.chunk for r in retrieval.ingested(store, docs).collect()}
    assert got["b.txt", 0, "MULTI"] == "first" and got["a.txt", 0, "MULTI"] == "kept" and got["z.txt", 0, "MULTI"] == "kept too"
    assert got["a.txt", 0, "FIBRE"].startswith("w0x0 ") and {k[1] for k in got if k[0] == "a.txt"} == {0, 1, 2} and len(got) == 6
    again = retrieval.ingested(retrieval.ingested(store, docs), docs)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in retrieval.ingested(store, docs).collect()}


def test_context_and_questions(spark, tmp_path):
    found = spark.createDataFrame([(1, 7, 2), (1, 8, 1), (1, 9, 3), (2, 9, 1)], "query_id long, doc_id long, rank int")
    texts = spark.createDataFrame([(7, "a", "x"), (8, "b", "y"), (9, "a", "z")], "doc_id long, source string, text string")
    got = {r.query_id: (r.context, r.sources) for r in retrieval.context(found, texts).collect()}
    assert got == {1: ("[SOURCE: b] y\n\n[SOURCE: a] x\n\n[SOURCE: a] z", ["b", "a"]), 2: ("[SOURCE: a] z", ["a"])}
    (tmp_path / "q.jsonl").write_text('{"question": "a", "k": 1}\n\n{"question": "b", "k": 2}\n')
    assert sorted((r.question, r.k) for r in retrieval.read_questions(spark, str(tmp_path / "q.jsonl")).collect()) == [("a", 1), ("b", 2)]


def test_one_series_of_a_mart(spark):
    rows = [(D(2024, 1, 1), "FIBRE", "P1", "TUNIS", 10, 2, 4, 40.0, 5.0), (D(2024, 1, 1), "FIBRE", "P2", "tunis ", 30, 4, 6, 20.0, 7.0), (D(2024, 4, 1), "FIBRE", "P1", "TUNIS", 5, 1, 0, 0.0, 9.0), (D(2024, 2, 1), "VOD", "P1", "SFAX", 8, 1, 1, 12.5, 3.0)]
    mart = spark.createDataFrame(rows, "date date, service_code string, product_id string, region_key string, nb_ventes long, nb_dealers_actifs long, nb_ventes_promo long, pct_ventes_promo double, prix_moyen double")
    got = series.sales_series(mart, "month", "FIBRE", "region", "Tunis").orderBy("date").collect()
    assert [(r.date.month, r.nb_ventes, r.nb_dealers_actifs, round(r.pct_ventes_promo, 6), r.prix_moyen, r.region_key) for r in got] == [(1, 40.0, 3.0, 25.0, 6.0, "TUNIS"), (2, 0.0, 0.0, 0.0, 0.0, "TUNIS"), (3, 0.0, 0.0, 0.0, 0.0, "TUNIS"), (4, 5.0, 1.0, 0.0, 9.0, "TUNIS")]
    assert series.sales_series(mart).count() == 4 and series.sales_series(mart, level="product", member="P2").count() == 1
    with pytest.raises(ValueError):
        series.sales_series(mart, level="region")


def test_seasonal_difference(spark):
    rows = spark.createDataFrame([("a", D(2024, m, 1), float(m * m)) for m in range(1, 6)] + [("b", D(2024, 1, 1), 3.0)], "k string, date date, y double")
    got = {(r.k, r.date.month): r.s for r in rows.select("*", series.seasonal_difference("y", ["k"], 3).alias("s")).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 3): None, ("a", 4): 15.0, ("a", 5): 21.0, ("b", 1): None}


def test_uploads(spark):
    rows = [("P", "1", "2024-01", "TUNIS"), ("P", "1", "2024/01", "TUNIS"), (" ", "1", "2024-01", "TUNIS"), ("P", "1", "2024-01", None), (None, "2", None, None)]
    df = spark.createDataFrame(rows, "COD_PROD string, QTE_STK string, YEAR_MONTH string, GOVERNORATE string")
    assert files.rejected_5g(df).count() == 4 and files.stock_5g_frame(df).count() == 1
    stock = spark.createDataFrame([("BOX",), ("UNKNOWN",), (" ",), (None,), ("SIM",)], "product_family string")
    up = spark.createDataFrame([("A",), ("unknown",), (" ",), ("A",)], "COD_FAM string")
    get = lambda *a: sorted(r.family for r in files.families(*a).collect())
    assert [get(up, None, stock), get(None, up, stock), get(stock.withColumnRenamed("product_family", "X"), None, stock), get(up.where("COD_FAM <> 'A'"), None, stock)] == [["A"], ["A"], ["BOX", "SIM"], ["BOX", "SIM"]]


def test_pairs_and_keys(spark):
    table = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "product int, place string, low int")
    pairs = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "product int, place string")
    assert [tuple(r) for r in sinks.of_pairs(table, pairs).select("product", "place", "low").collect()] == [(1, "a", 5)]
    assert one(spark, sinks.forecast_key(F.lit("s1"), F.lit(None).cast("string"), F.lit("region"), F.lit("TUNIS")))[0] == "s1:forecast:svc=ALL:tl=region:tv=TUNIS"


def test_elasticity_by_the_table_and_by_the_rules(spark):
    table = promo.elasticity_table(spark)
    asked = spark.createDataFrame([(s, float(d)) for s in ("FIBRE", "5G", "DATA_BUNDLE", "VOD", "OTHER") for d in (5, 7.5, 10, 15, 25, 49, 50)], "service string, discount double")
    by_rule = {(r.service, r.discount): (r.expected_uplift, r.post_dip) for r in promo.elasticity(asked, "discount", F.col("service")).collect()}
    met = asked.join(table, (F.col("discount") >= F.col("discount_min")) & (F.col("discount") <= F.col("discount_max")) & (F.col("service_type").isNull() | (F.col("service_type") == F.col("service"))))
    first = met.groupBy("service", "discount").agg(F.min(F.struct(F.col("service_type").isNull(), "discount_min", "expected_uplift", "post_dip")).alias("x"))
    assert {(r.service, r.discount): (r.x.expected_uplift, r.x.post_dip) for r in first.collect()} == by_rule and len(by_rule) == 35


def test_stock_levels(spark):
    cells = spark.createDataFrame([(D(2024, 1, 1), 1.0), (D(2026, 6, 1), 0.5), (D(2024, 1, 1), 0.001)], "month date, weight double")
    got = generators.stock_levels(cells, F.lit(100.0), 1.1, 2024).collect()
    for r in got:
        level = 100 * r.weight * 1.1 ** (r.month.year - 2024)
        stock = max(2, math.floor(level / 5 + 0.5) * 5)
        low, cap = max(2, math.floor(100 * r.weight * 0.15 + 0.5)), math.floor(100 * r.weight * 2.5 + 0.5)
        assert (r.stock_quantity, r.available_qty, r.stock_min_threshold, r.stock_max_capacity) == (stock, max(0, math.floor(stock * 0.9 + 0.5)), low, cap)
        assert (r.is_rupture, r.is_low_stock) == (stock <= low, stock <= max(2, math.floor(100 * r.weight * 0.25 + 0.5)))


def test_row_numbers(spark):
    rows = [(i * 7 % 50 if i % 3 else 0, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    for n in (1, 3, 40):
        got = sorted((r.row_number, r.a, r.b) for r in numbering.row_numbers(df, "a", F.desc("b"), partitions=n).collect())
        assert [(a, b) for _, a, b in got] == sorted(rows, key=lambda r: (r[0], -r[1])) and [x for x, _, _ in got] == list(range(1, 501))
    nothing = numbering.row_numbers(df.where("a < 0"), "a")
    assert nothing.collect() == [] and nothing.columns == ["a", "b", "row_number"]
    assert numbering.there(spark, "no_such_table") is None
