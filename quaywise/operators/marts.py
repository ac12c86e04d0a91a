"""Sales and stock marts: star joins and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.functions.scalar import all_of, chain, month_start, ratio
from quaywise.session import read


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a sale: order line with its date, service, and its region, dealer, offer and product, UNKNOWN where there is none.

    Dimensions are small next to the facts; the planner broadcasts those whose measured size allows it.
    """
    line, orders, customer, nation, region, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region", "part"))
    star = (
        line.join(orders, line.l_orderkey == orders.o_orderkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, nation.n_regionkey == region.r_regionkey, "left")
        .join(part, line.l_partkey == part.p_partkey, "left")
    )
    unknown = lambda c: F.coalesce(c, F.lit("UNKNOWN"))
    return star.select(
        F.col("o_orderdate").cast("date").alias("sale_date"),
        F.col("c_mktsegment").alias("service_code"),
        unknown("r_name").alias("region_key"),
        unknown("n_name").alias("region_label"),
        F.col("l_suppkey").alias("dealer_id"),
        unknown("p_brand").alias("offer_code"),
        unknown("p_type").alias("product_category"),
        F.col("p_retailprice").alias("price"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    )


def is_promo() -> Column:
    return F.col("discount") >= 0.05


def measures() -> list[Column]:
    """Number of sales, active dealers, promoted sales and their share, mean price."""
    promo = F.sum(F.when(is_promo(), 1).otherwise(0))
    return [
        F.count("*").alias("nb_ventes"),
        F.countDistinct("dealer_id").alias("nb_dealers_actifs"),
        promo.alias("nb_ventes_promo"),
        ratio(promo * 100, F.count("*")).alias("pct_ventes_promo"),
        F.avg("price").alias("prix_moyen"),
    ]


def daily_mart(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sale_date", "service_code").agg(*measures())


def monthly_mart(rows: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("service_code", "region_key", "product_category")
    return rows.groupBy(month_start(F.col("sale_date")).alias("month"), *keys).agg(*measures())


def filtered(rows: DataFrame, service: str | None = None, region: str | None = None, dealer: int | None = None, contains: str | None = None) -> DataFrame:
    """Optional equalities, upper or lower case and outer blanks aside, and a partial match of the region's label."""
    same = lambda c, v: None if v is None else F.lower(F.trim(F.col(c))) == v.strip().lower()
    return rows.where(all_of([same("service_code", service), same("region_key", region), None if dealer is None else F.col("dealer_id") == dealer, None if contains is None else F.col("region_label").ilike(f"%{contains}%")]))


def reaggregated(mart: DataFrame) -> DataFrame:
    """A monthly mart by date: sales and promoted sales summed, the rest averaged, labels the first by name."""
    return mart.groupBy("month").agg(
        F.sum("nb_ventes").alias("nb_ventes"),
        F.sum("nb_ventes_promo").alias("nb_ventes_promo"),
        F.avg("nb_dealers_actifs").alias("nb_dealers_actifs"),
        F.avg("pct_ventes_promo").alias("pct_ventes_promo"),
        F.avg("prix_moyen").alias("prix_moyen"),
        F.min("region_key").alias("region_key"),
    )


def starred(facts: DataFrame, services: DataFrame, products: DataFrame, geo: DataFrame, offers: DataFrame) -> DataFrame:
    """Sales facts (vente_id, sale_date, service_id, product_id, geo_id, offre_id, promo_id, dealer_id) with their dimensions.

    A service is required; product, place and offer are optional and then UNKNOWN. The price is that of the offer, else of
    the product.
    """
    rows = facts.join(services.select("service_id", "service_code"), "service_id")
    rows = rows.join(products.select("product_id", "product_name", "product_category", F.col("price").alias("product_price")), "product_id", "left")
    rows = rows.join(geo.select("geo_id", "region_code", "governorate", "city"), "geo_id", "left")
    rows = rows.join(offers.select("offre_id", "offre_code", "offre_name", F.col("price").alias("offer_price"), "category", "debit"), "offre_id", "left")
    known = lambda *c: F.coalesce(*[F.col(x).cast("string") for x in c], F.lit("UNKNOWN"))
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select(
        "sale_date",
        "service_code",
        "service_id",
        known("product_id").alias("product_id"),
        known("product_name").alias("product_name"),
        known("product_category").alias("product_category"),
        known("region_code", "governorate", "city").alias("region_key"),
        known("governorate", "city").alias("region_label"),
        known("offre_code").alias("offer_code"),
        known("offre_name", "offre_code").alias("offer_name"),
        F.coalesce(filled("category"), filled("debit"), F.lit("UNKNOWN")).alias("offer_category"),
        "vente_id",
        "dealer_id",
        "promo_id",
        "offer_price",
        F.coalesce("offer_price", "product_price").alias("price"),
    )


#: What the finest sales marts are kept by, besides the month or the day.
FINE_KEYS = ("service_code", "service_id", "product_id", "product_name", "product_category", "region_key", "region_label")


def fine_mart(rows: DataFrame, unit: str = "month", price: str = "price", keys: tuple[str, ...] = FINE_KEYS) -> DataFrame:
    """Sales, active dealers, promoted sales (each sale once) and their share, and the mean price, by month (with its year and
    number) or day and the finest keys.

    Rows are shuffled once, by the keys; the first one of a dealer and of a promoted sale is marked where it then lies. Distinct
    counts of two columns would shuffle each row three times.
    """
    promo = F.col("promo_id").isNotNull()
    date = {"month_start": month_start(F.col("sale_date")), "year": F.year("sale_date"), "month": F.month("sale_date")} if unit == "month" else {"date": F.col("sale_date")}
    group = [*date, *keys]
    first = lambda *c: F.row_number().over(W.partitionBy(*group, *c).orderBy(c[-1])) == 1
    rows = rows.select(*[c.alias(n) for n, c in date.items()], *keys, "dealer_id", F.when(promo, F.col("vente_id")).alias("_sale"), promo.alias("_promo"), F.col(price).alias("_price"), "vente_id").repartition(*group)
    rows = rows.withColumn("_dealer", first("dealer_id") & F.col("dealer_id").isNotNull()).withColumn("_first", first("_promo", "vente_id") & F.col("_sale").isNotNull())
    return rows.groupBy(*group).agg(
        F.count("*").alias("nb_ventes"),
        F.count_if("_dealer").alias("nb_dealers_actifs"),
        F.count_if("_first").alias("nb_ventes_promo"),
        ratio(F.count_if("_promo") * 100, F.count("*")).alias("pct_ventes_promo"),
        F.avg("_price").alias("prix_moyen"),
    )


def offer_mart(rows: DataFrame) -> DataFrame:
    """Sales by offer, whose category falls back on the offer itself."""
    category = F.coalesce(F.nullif(F.trim("product_category"), F.lit("")), F.col("offer_code"))
    return rows.groupBy(month_start(F.col("sale_date")).alias("month"), "offer_code", category.alias("category")).agg(*measures())


def stock(rows: DataFrame) -> DataFrame:
    """Monthly stock of a category in a region: what came in, what was sold and returned, and the balance so far (not below 0)."""
    month = rows.groupBy(month_start(F.col("sale_date")).alias("month"), "product_category", "region_label").agg(
        F.sum("qty").alias("qty"),
        F.sum(F.when(F.col("returnflag") == "N", F.col("qty")).otherwise(0.0)).alias("received"),
        F.sum(F.when(F.col("returnflag") != "N", F.col("qty")).otherwise(0.0)).alias("sold"),
        F.sum(F.when(F.col("returnflag") == "R", F.col("qty")).otherwise(0.0)).alias("activations"),
        F.sum(F.when(F.col("linestatus") == "O", 1).otherwise(0)).alias("real_count"),
        F.sum(F.when(F.col("linestatus") == "F", 1).otherwise(0)).alias("simulated_count"),
    )
    so_far = W.partitionBy("product_category", "region_label").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return month.withColumn("on_hand", F.greatest(F.lit(0.0), F.sum(F.col("received") - F.col("sold")).over(so_far)))


def stock_flags(rows: DataFrame, low: int = 10, high: int = 500) -> DataFrame:
    """Stock rows (on_hand) with their flags and one of four states; low and high stand for a product's own limits."""
    q = F.col("on_hand")
    flags = {"is_rupture": q <= 0, "is_low_stock": q < low, "has_zero_stock": q <= 0, "has_negative_stock": q < 0, "understock_risk": q < low, "overstock_risk": q > high, "stock_vs_min": q - low, "stock_vs_max": q - high}
    status = chain([(F.col("has_zero_stock"), "OUT_OF_STOCK"), (F.col("understock_risk"), "LOW_STOCK"), (F.col("overstock_risk"), "HIGH_STOCK")], "NORMAL")
    return rows.withColumns(flags).withColumn("status", status)


def stock_position(stock: DataFrame, dealers: DataFrame, geo: DataFrame) -> DataFrame:
    """Stock rows (dealer_id) with their dealer and its place, which may both be missing, and their state."""
    rows = stock.join(dealers.select("dealer_id", "dealer_name", "geo_id"), "dealer_id", "left")
    rows = rows.join(geo.select("geo_id", "governorate", "city"), "geo_id", "left")
    return stock_flags(rows)


def stock_summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Total and mean stock, empty and low places, by month and the given keys."""
    return stock_flags(rows).groupBy("month", *keys).agg(F.sum("on_hand").alias("stock_total"), F.count_if("is_rupture").alias("nb_ruptures"), F.count_if("is_low_stock").alias("nb_low_stock"), F.avg("on_hand").alias("stock_moyen_warehouse"))


def ruptures(rows: DataFrame, days: DataFrame) -> DataFrame:
    """days (date) with whether any stock row (month, on_hand, available) between the first of its month and the day is empty.

    A rupture, a stock of nothing and nothing available all count. Rows meet the days of their own month only.
    """
    gone = (F.col("on_hand") <= 0) | (F.coalesce("available", F.lit(1.0)) == 0)
    empty = rows.where(gone).groupBy("month").agg(F.count("*").alias("_n"))
    return days.withColumn("month", month_start(F.col("date"))).join(empty, "month", "left").withColumn("has_rupture", F.coalesce("_n", F.lit(0)) > 0).drop("month", "_n")
