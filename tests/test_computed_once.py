"""What is joined or numbered over all sales is computed once, whatever uses it."""

from quaywise.plans import models

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return plan(df).count("FileScan parquet")


def test_sales_are_joined_once_for_all_trees(spark):
    rows, _ = models.boosted(spark, DATA)
    assert scans(rows) == scans(models.monthly_parts(spark, DATA)) == 0
