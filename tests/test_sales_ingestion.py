"""Uploads of sales: one pass over the rows, in the order of all lines."""

from pyspark.sql import functions as F
from quaywise.functions import scalar
from quaywise.plans import warehouse
from quaywise.session import read
from quaywise.sources import sinks

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_of_one_number_are_upserted_in_their_order(spark, tmp_path):
    """Numbers are cut to eight digits, so that two orders share one: the dealer is that of the last order, the product of the first."""
    some = read(spark, DATA, "lineitem").limit(1).drop("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    keys = [(14285717, 1, 6, 32), (14285716, 1, 12, 31), (14285716, 2, 6, 33)]
    lines = spark.createDataFrame(keys, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").crossJoin(some)
    for i in range(2):  # whichever comes first
        folder = str(tmp_path / str(i))
        lines.orderBy(F.asc("l_orderkey") if i else F.desc("l_orderkey")).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
        got = warehouse.sales_ingestion(spark, folder)
        assert [(r.msisdn, r.dealer_id, r.product_id) for r in got.collect()] == [("21610000001", "D32", "Fibre 100")]
    assert "Window" not in plan(got)


def test_upserts_compute_their_rows_once(spark):
    rows = read(spark, DATA, "orders").select(F.nullif(F.col("o_orderkey") % 50, F.lit(7)).alias("k"), F.col("o_custkey").alias("a"), F.col("o_orderdate").alias("b"), F.col("o_orderkey").alias("seq"))
    got = sinks.upserted(rows.limit(0), rows, ["k"], ["a"])
    assert plan(sinks.upserted(rows.where("seq < 0"), rows, ["k"], ["a"])).count("FileScan parquet") == 2
    alone = rows.where("k IS NULL")
    assert sorted(map(tuple, got.where("k IS NULL").collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr) and alone.count() > 10
    assert got.where("k IS NOT NULL").count() == rows.where("k IS NOT NULL").select("k").distinct().count()


def test_dates_are_read_as_the_parser_reads_them(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-2-29", "2024-02-29 10:11:12", "2024-02-29t10:11:12", "2024-02-29T10:11", "2024-02-29 10:11", "2024/02/29", "20240229", "+20240-02-29", "-2024-02-29", "0000-01-01", "29/02/2024", "29/02/2024 23:59",
             "29/02/2024 24:00:00", "29-02-2024", "29.02.2024", "9.02.2024", "29.02.24", "", "x", "2024-02-29 ", "٢٠٢٤-02-29", "12024-02-29", "120240229", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for form in scalar.YEAR_FIRST + scalar.DAY_FIRST:
        both = rows.select(scalar.read_date(F.col("t"), form).cast("string").alias("a"), F.try_to_timestamp("t", F.lit(form)).cast("string").alias("b")).collect()
        assert [r.a for r in both] == [r.b for r in both] and any(r.a for r in both) == any(r.b for r in both)
