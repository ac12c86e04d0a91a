"""The finest marts count dealers and promoted sales once, and shuffle each sale once."""

from quaywise.operators import marts


def test_distinct_counts_without_copies_of_rows(spark):
    columns = "sale_date date, service_code string, offer string, dealer_id long, vente_id long, promo_id int, price double"
    rows = [("2024-01-01", "A", "x", 1, 10, 1, 2.0), ("2024-01-01", "A", "x", 1, 10, 1, 4.0), ("2024-01-01", "A", "x", 2, 10, None, None), ("2024-01-01", "A", "x", None, 11, 1, 6.0), ("2024-01-01", "A", None, 1, None, 1, 1.0), (None, "A", None, 1, 12, None, 3.0)]
    frame = spark.createDataFrame(rows, columns.replace("sale_date date", "d string")).selectExpr("cast(d as date) sale_date", "*")
    mart = marts.fine_mart(frame, "day", keys=("service_code", "offer"))
    got = {(str(r.date), r.offer): tuple(r)[3:] for r in mart.collect()}
    assert got == {("2024-01-01", "x"): (4, 2, 2, 75.0, 4.0), ("2024-01-01", None): (1, 1, 0, 100.0, 1.0), ("None", None): (1, 1, 0, 0.0, 3.0)}
    assert "Expand" not in mart._jdf.queryExecution().executedPlan().toString()
