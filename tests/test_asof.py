from quaywise.operators import marts
from quaywise.plans import queries as demand

DATA = "/root/testdata/sf0.001"


def test_every_category_and_sale_day_gets_its_price(spark):
    asked = marts.sales(spark, DATA).select("product_category", "sale_date").distinct()
    for name in ("asof_price", "asof_price_all_days"):
        got = demand.QUERIES[name](spark, DATA)
        assert got.count() == asked.count() > 0
        assert got.join(asked, ["product_category", "sale_date"], "left_anti").count() == 0
