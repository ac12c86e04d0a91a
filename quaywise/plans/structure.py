"""Registered queries of global numbers and of the presence of columns."""

from __future__ import annotations


import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.operators import numbering
from quaywise.plans.queries import query
from quaywise.session import read, shared_folder
from quaywise.sources.stores import Store

LINES = "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_partkey) AS row_number FROM lineitem"


def lines(spark, d):
    rows = read(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return numbering.row_numbers(rows, *rows.columns).select("l_orderkey", "l_linenumber", "row_number")


@query(LINES)
def global_row_number(spark, d):
    return lines(spark, d)


@query(
    f"""WITH n AS ({LINES}), s AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS m, count(*) OVER () AS c FROM supplier)
SELECT l_orderkey, l_linenumber, row_number, s_suppkey FROM n JOIN s ON (row_number - 1) % c + 1 = m"""
)
def dealers_in_turn(spark, d):
    """Every line of the table with a number over all and a supplier in turn."""
    return numbering.dealt(lines(spark, d), read(spark, d, "supplier"), "s_suppkey")


EXPECTED = {"lineitem": ("l_shipdate", "l_discount", "l_promotion"), "documents": ("doc_id", "text", "lang", "is_ramadan"), "warehouse": ("code",)}


@query(
    """SELECT * FROM (SELECT 'lineitem' AS table_name, 'l_shipdate' AS column_name, true AS present, count(l_shipdate) AS filled FROM lineitem
UNION ALL SELECT 'lineitem', 'l_discount', true, count(l_discount) FROM lineitem UNION ALL SELECT 'documents', 'doc_id', true, count(doc_id) FROM documents
UNION ALL SELECT 'documents', 'text', true, count(text) FROM documents UNION ALL SELECT 'documents', 'lang', true, count(lang) FROM documents
UNION ALL SELECT 'lineitem', 'l_promotion', false, NULL UNION ALL SELECT 'documents', 'is_ramadan', false, NULL UNION ALL SELECT 'warehouse', 'code', false, NULL)"""
)
def column_presence(spark, d):
    tables = {n: read(spark, d, n) for n in ("lineitem", "documents")} | {"warehouse": numbering.there(spark, "warehouse")}
    return numbering.presence(tables, EXPECTED)


@query(
    """WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_shipdate, l_extendedprice, l_discount, l_tax) AS i FROM lineitem)
SELECT l_orderkey, l_partkey, arg_min(l_suppkey, i) AS l_suppkey, arg_max(l_quantity, i) AS l_quantity, l_orderkey % 8 AS bucket FROM t GROUP BY 1, 2"""
)
def stored_sales(spark, d):
    """All lines loaded into a new store in the shared folder: first lines of an order and part, then what comes later; one load is repeated."""
    place = W.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice", "l_discount", "l_tax")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", (F.col("l_orderkey") % 8).alias("bucket"), F.row_number().over(place).alias("seq"))
    folder = f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}.lines")  # numbered once for all loads
    rows = spark.read.parquet(f"{folder}.lines")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("seq").schema.fields)
    store = Store(folder, schema, "bucket", ("l_orderkey", "l_partkey", "bucket"), ("l_quantity",))
    for name, part in (("first", "seq = 1"), ("later", "seq > 1"), ("first", "seq = 1")):
        store.load(rows.where(part), name)
    return store.table(spark)
