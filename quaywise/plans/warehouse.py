"""More registered queries: marts with optional dimensions, feature frames, loads, training runs, promotions, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaywise.functions import scalar
from quaywise.operators import anomaly, forecast, generators, inventory, marts, promo, retrieval, series
from quaywise.plans import queries as q
from quaywise.plans.queries import FOUND, FUSED, K, MONTHLY, STOCK_FACTS, found, query, r, rounded
from quaywise.session import read
from quaywise.sources import files, sinks

QUERIES, ORACLES = q.QUERIES, q.ORACLES

# marts with optional dimensions: some products, places and offers of the facts are unknown, some offers have no price

STAR = """facts AS (
 SELECT l_orderkey * 10 + l_linenumber AS vente_id, CAST(o_orderdate AS DATE) AS sale_date, c_mktsegment AS service_id, l_suppkey AS dealer_id, c_nationkey AS geo_id, p_brand AS offre_id, l_partkey AS product_id, CASE WHEN l_discount >= 0.05 THEN 1 END AS promo_id
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN part ON l_partkey = p_partkey),
products AS (SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_category, p_retailprice AS price FROM part WHERE p_partkey % 50 <> 0),
geo AS (SELECT n_nationkey AS geo_id, CASE WHEN n_nationkey % 6 <> 0 THEN r_name END AS region_code, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS governorate, lower(n_name) AS city FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7),
offers AS (SELECT p_brand AS offre_id, p_brand AS offre_code, CASE WHEN p_brand NOT LIKE '%3' THEN 'Offer ' || p_brand END AS offre_name, CASE WHEN p_brand NOT LIKE '%2' THEN min(p_retailprice) END AS price, CASE WHEN p_brand LIKE '%1' THEN ' ' ELSE 'standard' END AS category, CASE WHEN p_brand LIKE '%11' THEN '' ELSE '100M' END AS debit FROM part WHERE p_brand NOT LIKE '%5' GROUP BY p_brand),
star AS (
 SELECT sale_date, s.service_code, s.service_id, coalesce(p.product_id::VARCHAR, 'UNKNOWN') AS product_id, coalesce(product_name, 'UNKNOWN') AS product_name, coalesce(product_category, 'UNKNOWN') AS product_category,
  coalesce(region_code, governorate, city, 'UNKNOWN') AS region_key, coalesce(governorate, city, 'UNKNOWN') AS region_label, coalesce(offre_code, 'UNKNOWN') AS offer_code, coalesce(offre_name, offre_code, 'UNKNOWN') AS offer_name,
  coalesce(nullif(trim(category), ''), nullif(trim(debit), ''), 'UNKNOWN') AS offer_category, vente_id, dealer_id, promo_id, o.price AS offer_price, coalesce(o.price, p.price) AS price
 FROM facts f JOIN (SELECT DISTINCT c_mktsegment AS service_id, c_mktsegment AS service_code FROM customer) s ON f.service_id = s.service_id
 LEFT JOIN products p ON f.product_id = p.product_id LEFT JOIN geo g ON f.geo_id = g.geo_id LEFT JOIN offers o ON f.offre_id = o.offre_id)"""


def star(spark, d):
    line, orders, customer, part, nation, region = (read(spark, d, t) for t in ("lineitem", "orders", "customer", "part", "nation", "region"))
    facts = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"), "left")
    facts = facts.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("vente_id"), F.col("o_orderdate").cast("date").alias("sale_date"), F.col("c_mktsegment").alias("service_id"), F.col("l_suppkey").alias("dealer_id"), F.col("c_nationkey").alias("geo_id"),
        F.col("p_brand").alias("offre_id"), F.col("l_partkey").alias("product_id"), F.when(F.col("l_discount") >= 0.05, 1).alias("promo_id"),
    )
    services = customer.select(F.col("c_mktsegment").alias("service_id"), F.col("c_mktsegment").alias("service_code")).distinct()
    products = part.where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("product_category"), F.col("p_retailprice").alias("price"))
    geo = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey <> 7").select(
        F.col("n_nationkey").alias("geo_id"), F.when(F.col("n_nationkey") % 6 != 0, F.col("r_name")).alias("region_code"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_name")).alias("governorate"), F.lower("n_name").alias("city")
    )
    b = F.col("p_brand")
    offers = part.where(~b.endswith("5")).groupBy("p_brand").agg(F.min("p_retailprice").alias("least")).select(
        b.alias("offre_id"), b.alias("offre_code"), F.when(~b.endswith("3"), F.concat(F.lit("Offer "), b)).alias("offre_name"), F.when(~b.endswith("2"), F.col("least")).alias("price"), F.when(b.endswith("1"), " ").otherwise("standard").alias("category"), F.when(b.endswith("11"), "").otherwise("100M").alias("debit")
    )
    # the product of a fact counts as unknown where its dimension has no row
    return marts.starred(facts.join(products.select("product_id", F.lit(True).alias("_p")), "product_id", "left").withColumn("product_id", F.when(F.col("_p"), F.col("product_id"))).drop("_p"), services, products, geo, offers)


SALES_MEASURES = """count(*) AS nb_ventes, count(DISTINCT dealer_id) AS nb_dealers_actifs, count(DISTINCT CASE WHEN promo_id IS NOT NULL THEN vente_id END) AS nb_ventes_promo,
 {pct} AS pct_ventes_promo, {price} AS prix_moyen"""
PCT = "sum(CASE WHEN promo_id IS NOT NULL THEN 1 ELSE 0 END) * 100.0::DOUBLE / nullif(count(*), 0)"
FINE = ", ".join(marts.FINE_KEYS)


@query(f"WITH {STAR} SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month_start, CAST(year(sale_date) AS INT) AS year, CAST(month(sale_date) AS INT) AS month, {FINE}, {SALES_MEASURES.format(pct=r(PCT), price=r('avg(price)'))} FROM star GROUP BY 1, 2, 3, {FINE}")
def monthly_fine_mart(spark, d):
    return rounded(marts.fine_mart(star(spark, d)), "pct_ventes_promo", "prix_moyen")


@query(f"WITH {STAR} SELECT sale_date AS date, {FINE}, {SALES_MEASURES.format(pct=r(PCT), price=r('avg(price)'))} FROM star GROUP BY 1, {FINE}")
def daily_fine_mart(spark, d):
    return rounded(marts.fine_mart(star(spark, d), "day"), "pct_ventes_promo", "prix_moyen")


OFFER_KEYS = ("service_code", "offer_code", "offer_name", "offer_category", "region_key", "region_label")


@query(f"WITH {STAR} SELECT sale_date AS date, {', '.join(OFFER_KEYS)}, {SALES_MEASURES.format(pct=r(PCT), price=r('avg(coalesce(offer_price, 0))'))} FROM star GROUP BY 1, {', '.join(OFFER_KEYS)}")
def daily_offer_mart(spark, d):
    rows = star(spark, d).withColumn("offer_price", F.coalesce("offer_price", F.lit(0.0)))
    return rounded(marts.fine_mart(rows, "day", "offer_price", OFFER_KEYS), "pct_ventes_promo", "prix_moyen")


@query(
    f"""WITH {STOCK_FACTS}, s AS (SELECT date, product_id, governorate, stock_qty AS on_hand, s_suppkey AS dealer_id FROM facts LEFT JOIN (SELECT n_name, min(s_suppkey) AS s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) ON n_name = governorate)
SELECT date, product_id, s.dealer_id, s_name AS dealer_name, n_name AS dealer_governorate, on_hand, CASE WHEN on_hand <= 0 THEN 'OUT_OF_STOCK' WHEN on_hand < 10 THEN 'LOW_STOCK' WHEN on_hand > 500 THEN 'HIGH_STOCK' ELSE 'NORMAL' END AS status
FROM s LEFT JOIN supplier ON s.dealer_id = s_suppkey AND s_suppkey % 3 <> 0 LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 4 <> 0"""
)
def stock_position(spark, d):
    supplier, nation = read(spark, d, "supplier"), read(spark, d, "nation")
    first = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("governorate")).agg(F.min("s_suppkey").alias("dealer_id"))
    rows = q.stock_facts(spark, d).select("date", "product_id", "governorate", F.col("stock_qty").alias("on_hand")).join(first, "governorate", "left").drop("governorate")
    dealers = supplier.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("dealer_id"), F.col("s_name").alias("dealer_name"), F.col("s_nationkey").alias("geo_id"))
    geo = nation.where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("geo_id"), F.col("n_name").alias("governorate"), F.lit(None).cast("string").alias("city"))
    return marts.stock_position(rows, dealers, geo).select("date", "product_id", "dealer_id", "dealer_name", F.col("governorate").alias("dealer_governorate"), "on_hand", "status")


# series and feature frames

SERIES = f"""{STAR}, mart AS (SELECT service_code, CAST(date_trunc('month', sale_date) AS DATE) AS date, region_key, {SALES_MEASURES.format(pct=PCT, price='avg(price)')} FROM star GROUP BY 1, 2, 3),
agg AS (SELECT service_code, date, min(region_key) AS region_key, sum(nb_ventes)::DOUBLE AS nb_ventes, avg(nb_dealers_actifs) AS nb_dealers_actifs, sum(nb_ventes_promo)::DOUBLE AS nb_ventes_promo, avg(prix_moyen) AS prix_moyen FROM mart GROUP BY 1, 2),
spine0 AS (SELECT service_code, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS date FROM agg GROUP BY 1),
dense AS (SELECT s.service_code, s.date, coalesce(nb_ventes, 0.0) AS nb_ventes, coalesce(nb_dealers_actifs, 0.0) AS nb_dealers_actifs, coalesce(nb_ventes_promo, 0.0) AS nb_ventes_promo, coalesce(prix_moyen, 0.0) AS prix_moyen,
 coalesce(last_value(region_key IGNORE NULLS) OVER (PARTITION BY s.service_code ORDER BY s.date), first_value(region_key IGNORE NULLS) OVER (PARTITION BY s.service_code ORDER BY s.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 'UNKNOWN') AS region_key,
 CASE WHEN coalesce(nb_ventes, 0) > 0 THEN nb_ventes_promo * 100 / nb_ventes ELSE 0.0 END AS pct_ventes_promo FROM spine0 s LEFT JOIN agg a ON s.service_code = a.service_code AND s.date = a.date)"""
FLOATS = ("nb_dealers_actifs", "prix_moyen", "pct_ventes_promo")


def dense(spark, d):
    """Monthly sales of every service, without gaps."""
    mart = marts.fine_mart(star(spark, d).withColumn("sale_date", F.trunc("sale_date", "MM")), "day", "price", ("service_code", "region_key"))
    by = mart.groupBy("service_code", "date").agg(F.min("region_key").alias("region_key"), F.sum("nb_ventes").alias("nb_ventes"), F.avg("nb_dealers_actifs").alias("nb_dealers_actifs"), F.sum("nb_ventes_promo").alias("nb_ventes_promo"), F.avg("prix_moyen").alias("prix_moyen"), F.lit(0.0).alias("pct_ventes_promo"))
    return series.dense_sales(by, ["service_code"])


@query(f"WITH {SERIES} SELECT service_code, date, region_key, nb_ventes, nb_ventes_promo, {', '.join(f'{r(c)} AS {c}' for c in FLOATS)} FROM dense")
def dense_sales(spark, d):
    return rounded(dense(spark, d), *FLOATS).select("service_code", "date", "region_key", "nb_ventes", "nb_ventes_promo", *FLOATS)


OVER = "OVER (PARTITION BY service_code ORDER BY date{})"
LAGS = ", ".join(f"coalesce(lag(nb_ventes, {n}) {OVER.format('')}, 0) AS sales_lag_{n}" for n in (1, 2, 3, 12))
ROLLS = ", ".join(f"{r(f'avg({c}) {OVER.format(f' ROWS {n - 1} PRECEDING')} + 1e-9')} AS {a}_{n}" for c, a in (("nb_ventes", "sales_roll"), ("prix_moyen", "price_roll")) for n in (3, 6, 12))
ROLLED = [f"{a}_{n}" for a in ("sales_roll", "price_roll") for n in (3, 6, 12)]


def off_edge(df, *columns):
    """Means that may lie half way between two roundings, moved off there as in the SQL, which adds in another order."""
    return df.withColumns({c: F.col(c) + 1e-9 for c in columns})


@query(
    f"""WITH {SERIES} SELECT service_code, date, nb_ventes, CAST(row_number() {OVER.format('')} - 1 AS INT) AS trend_index, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, {r("sin(month(date) * (2 * pi() / 12))")} AS month_sin, {r("cos(month(date) * (2 * pi() / 12))")} AS month_cos,
 CAST(nb_ventes_promo > 0 AS INT) AS promo_active, {r("CASE WHEN nb_ventes > 0 THEN nb_ventes_promo / nb_ventes ELSE 0.0 END")} AS promo_rate, {r("prix_moyen")} AS prix_moyen, {r("nb_dealers_actifs")} AS nb_dealers_actifs, {LAGS}, {ROLLS}, CAST(service_code = 'BUILDING' AS INT) AS "service_BUILDING" FROM dense"""
)
def monthly_features(spark, d):
    out = series.sales_features(dense(spark, d), ["service_code"], services=("BUILDING",))
    return rounded(off_edge(out, *ROLLED), "month_sin", "month_cos", "promo_rate", "prix_moyen", "nb_dealers_actifs", *ROLLED)


@query(f"WITH {SERIES}, f AS (SELECT service_code, date, nb_ventes, CAST(row_number() {OVER.format('')} - 1 AS INT) AS trend_index, {r('nb_dealers_actifs')} AS nb_dealers_actifs, {LAGS}, {ROLLS} FROM dense) SELECT * EXCLUDE (price_roll_3, price_roll_6, price_roll_12) FROM f")
def features_without_groups(spark, d):
    out = series.sales_features(dense(spark, d), ["service_code"], promotions=False, price=False, calendar_too=False)
    return rounded(off_edge(out, *ROLLED[:3]), "nb_dealers_actifs", *ROLLED[:3])


EVENT_DAYS = """ev AS (SELECT event_type AS service_code, CAST(ts AS DATE) AS date, count(*)::DOUBLE AS nb_ventes, count(DISTINCT user_id)::DOUBLE AS nb_dealers_actifs, count(*) FILTER (user_id % 7 = 0)::DOUBLE AS nb_ventes_promo, avg(value) AS prix_moyen FROM events GROUP BY 1, 2)"""


def event_days(spark, d):
    """Events by type and day as daily sales of a service, their users as dealers, their values as prices."""
    return read(spark, d, "events").groupBy(F.col("event_type").alias("service_code"), F.col("ts").cast("date").alias("date")).agg(
        F.count("*").cast("double").alias("nb_ventes"), F.countDistinct("user_id").cast("double").alias("nb_dealers_actifs"), F.count_if(F.col("user_id") % 7 == 0).cast("double").alias("nb_ventes_promo"), F.avg("value").alias("prix_moyen")
    )


@query(
    f"""WITH {EVENT_DAYS} SELECT service_code, date, nb_ventes, CAST(row_number() {OVER.format('')} - 1 AS INT) AS trend_index, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(isodow(date) >= 6 AS INT) AS is_weekend, 0 AS is_ramadan, CAST(month(date) * 100 + day(date) IN (101, 114) AS INT) AS is_holiday,
 CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter, {r("sin(month(date) * (2 * pi() / 12))")} AS month_sin, {r("cos(month(date) * (2 * pi() / 12))")} AS month_cos, CAST(nb_ventes_promo > 0 AS INT) AS promo_active, {r("nb_ventes_promo / nb_ventes")} AS promo_rate,
 {r(f"avg(prix_moyen) {OVER.format(' ROWS 6 PRECEDING')}")} AS prix_moyen_lag7, {r(f"avg(nb_dealers_actifs) {OVER.format(' ROWS 6 PRECEDING')}")} AS nb_dealers_actifs_lag7, {r(f"avg(nb_dealers_actifs) {OVER.format(' ROWS 29 PRECEDING')}")} AS nb_dealers_actifs_lag30 FROM ev"""
)
def daily_features(spark, d):
    out = series.sales_features(event_days(spark, d), ["service_code"], "day")
    return rounded(out, "month_sin", "month_cos", "promo_rate", "prix_moyen_lag7", "nb_dealers_actifs_lag7", "nb_dealers_actifs_lag30")


HISTORY_SQL = """hist AS (SELECT date, governorate || ' | ' || coalesce(nullif(trim(product_type), ''), product_family) AS key, coalesce(nullif(trim(product_type), ''), product_family) AS product_type, governorate, {value} AS v, real FROM f0),
history AS (SELECT date, key, product_type, governorate, sum(v) AS value, count(*) AS records, count(*) FILTER (real) AS real_count, count(*) FILTER (NOT real) AS simulated_count FROM hist GROUP BY 1, 2, 3, 4)"""
FACTS_REAL = f"""{STOCK_FACTS}, rl AS (SELECT CAST(date_trunc('month', sale_date) AS DATE) AS date, product_category AS product_id, region_label AS governorate, count(*) FILTER (linestatus = 'O') > 0 AS real FROM sales GROUP BY 1, 2, 3),
f0 AS (SELECT facts.*, real FROM facts JOIN rl USING (date, product_id, governorate))"""


@query(f"WITH {FACTS_REAL}, {HISTORY_SQL.format(value='sales_qty + activations_qty')} SELECT * FROM history")
def inventory_demand_history(spark, d):
    return inventory.history(q.stock_facts(spark, d), "month", "demand", "by_governorate")


@query(f"WITH {FACTS_REAL}, {HISTORY_SQL.format(value='stock_qty')}, dn AS (SELECT *, count(*) FILTER (value > 0) OVER (PARTITION BY key) AS n FROM history) SELECT key, count(*) AS months, sum(value) AS value FROM dn WHERE n >= 6 GROUP BY 1")
def inventory_dense_scopes(spark, d):
    rows = inventory.dense_enough(inventory.history(q.stock_facts(spark, d), "month", "stock", "by_governorate"), "key", "value")
    return rows.groupBy("key").agg(F.count("*").alias("months"), F.sum("value").alias("value"))


@query(
    f"""WITH {MONTHLY}, a AS (SELECT *, avg(y) OVER w3 AS roll_3, coalesce(stddev_samp(y) OVER w3, 0.0) AS roll_std_3, row_number() OVER w AS i FROM monthly WINDOW w AS (PARTITION BY k ORDER BY date), w3 AS (PARTITION BY k ORDER BY date ROWS 2 PRECEDING))
SELECT k, date, coalesce(lag(y) OVER w, 0) AS lag_1, coalesce(lag(y, 12) OVER w, 0) AS lag_seasonal, {r("least(roll_std_3 / (roll_3 + 1e-6), 1.0)")} AS volatility, {r("coalesce((y - roll_3) - lag(y - roll_3) OVER w, 0.0)")} AS acceleration, {r("sin(month(date) * (2 * pi() / 12))")} AS month_sin, CAST(i - 1 AS INT) AS trend_index
FROM a WINDOW w AS (PARTITION BY k ORDER BY date)"""
)
def stock_feature_frame(spark, d):
    out = series.stock_features(q.monthly(spark, d), K, "y")
    return rounded(out, "volatility", "acceleration", "month_sin").select("k", "date", "lag_1", "lag_seasonal", "volatility", "acceleration", "month_sin", "trend_index")


# tests of forecasts

NN = "nn AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM monthly)"


@query(
    f"""WITH {MONTHLY}, {NN}, o AS (SELECT k, i, y, n, unnest(generate_series(greatest(12, i - 2), least(i, n - 3))) AS origin FROM nn WHERE least(i, n - 3) >= greatest(12, i - 2)),
p AS (SELECT o.k, origin, 'naive_last' AS model, o.y, h.y AS yhat FROM o JOIN nn h ON h.k = o.k AND h.i = origin - 1 UNION ALL SELECT o.k, origin, 'seasonal_naive', o.y, h.y FROM o JOIN nn h ON h.k = o.k AND h.i = o.i - 12)
SELECT k, CAST(origin AS INT) AS origin, model, {r("avg(abs(yhat - y))")} AS mae, {r("sqrt(avg((yhat - y) * (yhat - y)))")} AS rmse, count(*) AS n FROM p GROUP BY 1, 2, 3"""
)
def rolling_origin(spark, d):
    out = forecast.measured(forecast.rolling_origin(q.monthly(spark, d), K, "y"), ["k", "origin", "model"])
    return rounded(out, "mae", "rmse").select("k", F.col("origin").cast("int").alias("origin"), "model", "mae", "rmse", "n")


@query(
    f"""WITH {MONTHLY}, {NN}, p AS (SELECT a.k, 'naive_last' AS model, a.y, h.y AS yhat FROM nn a JOIN nn h ON h.k = a.k AND h.i = a.n - 7 WHERE a.i >= a.n - 6 UNION ALL SELECT a.k, 'seasonal_naive', a.y, h.y FROM nn a JOIN nn h ON h.k = a.k AND h.i = a.n - 18 WHERE a.i >= a.n - 6)
SELECT k, model, {r("avg(abs(yhat - y))")} AS mae, {r("avg((yhat - y) / y) * 100")} AS mpe, count(*) AS n FROM p GROUP BY 1, 2"""
)
def single_holdout(spark, d):
    out = forecast.measured(forecast.single_holdout(q.monthly(spark, d), K, "y", 6), ["k", "model"])
    return rounded(out, "mae", "mpe").select("k", "model", "mae", "mpe", "n")


REAL_WALK = f"""{q.CELLS}, nn AS (SELECT *, month(date) % 4 <> 0 AS real, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM cells),
tt AS (SELECT *, (i - (n - 18)) // 6 + 1 AS fold, n - (4 - ((i - (n - 18)) // 6 + 1)) * 6 AS origin FROM nn WHERE i >= n - 18 AND n >= 19),
ev AS (SELECT * FROM (SELECT *, max(real) OVER (PARTITION BY k, fold) AS any_real FROM tt) WHERE real OR NOT any_real), nz AS (SELECT * FROM (SELECT *, sum(abs(y)) OVER (PARTITION BY k, fold) AS s FROM ev) WHERE s >= 1e-9),
p AS (SELECT z.k, z.fold, 'naive_last' AS model, z.y, h.y AS yhat FROM nz z JOIN nn h ON h.k = z.k AND h.i = origin - 1 UNION ALL SELECT z.k, z.fold, 'seasonal_naive', z.y, h.y FROM nz z JOIN nn h ON h.k = z.k AND h.i = CASE WHEN origin >= 12 THEN origin - 12 + (z.i - origin) % 12 ELSE origin - 1 END),
fw AS (SELECT k, model, fold, sum(abs(y - yhat)) * 100 / sum(abs(y)) AS wape FROM p GROUP BY 1, 2, 3),
ww AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k, model) = 1 THEN 1.0 ELSE 0.5 + (row_number() OVER (PARTITION BY k, model ORDER BY fold) - 1) / greatest(count(*) OVER (PARTITION BY k, model) - 1, 1)::DOUBLE END AS w FROM fw)"""


@query(f"WITH {REAL_WALK} SELECT k, model, {r('sum(w * wape) / sum(w)')} AS score, count(*) AS folds FROM ww GROUP BY 1, 2")
def inventory_cross_validation(spark, d):
    rows = q.cells(spark, d).withColumn("real", (F.month("date") % 4 != 0).cast("int"))
    pairs = forecast.walk_forward_real(rows, K, "y", "real", 6)
    by = pairs.groupBy("k", "model", "fold").agg((F.sum(F.abs(F.col("y") - F.col("yhat"))) * 100 / F.sum(F.abs("y"))).alias("wape"))
    return rounded(forecast.recency_weighted(by, ["k", "model"], "wape").select("k", "model", "score", "folds"), "score")


@query(f"WITH {MONTHLY}, {q.WALK}, {q.SCORED}, f AS (SELECT k, unnest(['naive_last', 'seasonal_naive', 'lstm']) AS model FROM (SELECT DISTINCT k FROM scored)) SELECT f.k, f.model, {r('composite')} AS composite, CASE WHEN composite IS NULL THEN NULL ELSE CAST(row_number() OVER (PARTITION BY f.k ORDER BY composite NULLS LAST, f.model) AS INT) END AS rank, CASE WHEN composite IS NULL THEN 'failed' ELSE 'completed' END AS status FROM f LEFT JOIN scored s ON s.k = f.k AND s.model = f.model")
def training_run(spark, d):
    scores = q.scores(spark, d).select("k", "model", "composite")
    return rounded(forecast.ranked(scores, K, ("naive_last", "seasonal_naive", "lstm")), "composite").select("k", "model", "composite", "rank", "status")


@query(f"WITH {MONTHLY}, {q.WALK}, f AS (SELECT k, model, fold, string_agg(CAST(y AS BIGINT), ',' ORDER BY i) AS actuals, string_agg(CAST(yhat AS BIGINT), ',' ORDER BY i) AS predicted, {r('avg(yhat - y)')} AS bias FROM walk GROUP BY 1, 2, 3) SELECT k, model, CAST(fold AS INT) AS fold, actuals, predicted, bias FROM f")
def backtest_report(spark, d):
    rows = forecast.backtest_report(forecast.walk_forward(q.monthly(spark, d), K, "y"), ["k"]).select("k", "model", F.inline("folds"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",").alias(c)
    return rounded(rows.select("k", "model", F.col("fold").cast("int").alias("fold"), text("actuals"), text("predicted"), "bias"), "bias")


@query(
    f"""WITH {MONTHLY}, l AS (SELECT *, lag(y) OVER w AS sales_lag_1, lag(y, 12) OVER w AS sales_lag_12, avg(y) OVER w3 AS sales_roll_3, row_number() OVER w AS trend_index FROM monthly WINDOW w AS (PARTITION BY k ORDER BY date), w3 AS (PARTITION BY k ORDER BY date ROWS 2 PRECEDING)),
i AS (SELECT k, feature, abs(regr_slope(y, x)) AS importance FROM (UNPIVOT (SELECT k, y, sales_lag_1, sales_lag_12, sales_roll_3, trend_index::DOUBLE AS trend_index FROM l) ON sales_lag_1, sales_lag_12, sales_roll_3, trend_index INTO NAME feature VALUE x) GROUP BY 1, 2)
SELECT k, feature, floor(importance * 1e4 + 0.5) / 1e4 AS importance, floor(importance * 100 / sum(importance) OVER (PARTITION BY k) * 1e4 + 0.5) / 1e4 AS normalized_importance, CAST(row_number() OVER (PARTITION BY k ORDER BY importance DESC, feature) AS INT) AS rank,
 CASE feature WHEN 'sales_lag_1' THEN 'niveau de ventes de la periode precedente' WHEN 'sales_lag_12' THEN 'saisonnalite annuelle' WHEN 'sales_roll_3' THEN 'momentum commercial recent (moyenne des 3 dernieres periodes)' ELSE 'tendance de fond' END AS label FROM i WHERE importance > 0"""
)
def feature_importance(spark, d):
    rows = series.rolling(series.lags(q.monthly(spark, d), K, "y", (1, 12)), K, "y", (3,)).withColumn("trend_index", F.row_number().over(series.over(K)).cast("double"))
    names = {"sales_lag_1": "lag_1", "sales_lag_12": "lag_12", "sales_roll_3": "roll_3", "trend_index": "trend_index"}
    each = rows.select("k", "y", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).cast("double").alias("x")) for n, c in names.items()])))
    out = forecast.importances(each.groupBy("k", "feature").agg(F.abs(F.regr_slope("y", "x")).alias("importance")), K).withColumn("label", scalar.driver_label(F.col("feature")))
    four = lambda c: F.floor(F.col(c) * 1e4 + 0.5) / 1e4
    return out.withColumns({c: four(c) for c in ("importance", "normalized_importance")})


AHEAD = f"""{MONTHLY}, {NN}, ah AS (SELECT k, CAST(s AS INT) AS step, (SELECT y FROM nn p WHERE p.k = o.k AND p.i = o.n - 12 + (s - 1) % 12) AS yhat FROM (SELECT DISTINCT k, n FROM nn) o, range(1, 7) AS t(s))"""
TEXTS = ("hausse de 12.5 % puis -3%", "une baisse de -10%", "nouvelle promo", "rupture de stock", "rien")


@query(
    f"""WITH {AHEAD}, s AS (SELECT * FROM (VALUES ('{TEXTS[0]}', 0.125::DOUBLE), ('{TEXTS[1]}', -0.1), ('{TEXTS[2]}', 0.2), ('{TEXTS[3]}', -0.25), ('{TEXTS[4]}', 0.0)) v(text, shift))
SELECT k, step, text, {r("shift * 100")} AS shift_pct, {r("yhat * (1 + shift)")} AS scenario FROM ah, s"""
)
def what_if(spark, d):
    ahead = forecast.seasonal_naive(q.monthly(spark, d), K, "y", 6).select("k", "step", "yhat", F.explode(F.array(*map(F.lit, TEXTS))).alias("text"))
    return rounded(forecast.what_if(ahead, F.col("text")), "shift_pct", "scenario").select("k", "step", "text", "shift_pct", "scenario")


@query(f"WITH {AHEAD} SELECT k, min(yhat) AS least, max(yhat) AS most, {r('avg(yhat)')} AS mean, max(yhat) - min(yhat) <= greatest(1.0, abs(avg(yhat)) * 0.03) AS flat, max(yhat) - min(yhat) <= greatest(1.0, abs(avg(yhat)) * 0.03) OR count(DISTINCT round(yhat, 2)) <= 2 AS stable FROM ah GROUP BY k")
def flat_forecasts(spark, d):
    return rounded(forecast.is_flat(forecast.seasonal_naive(q.monthly(spark, d), K, "y", 6), K), "mean")


@query(f"WITH {AHEAD}, s AS (SELECT *, 1.28 * greatest(1.0, stddev_pop(yhat) OVER (PARTITION BY k)) AS w FROM ah) SELECT k, step, yhat, {r('greatest(0.0, yhat - w)')} AS lower, {r('yhat + w')} AS upper FROM s")
def stock_forecast_band(spark, d):
    out = forecast.steady_band(forecast.seasonal_naive(q.monthly(spark, d), K, "y", 6), K)
    return rounded(out, "lower", "upper").select("k", "step", "yhat", "lower", "upper")


@query(
    f"""WITH {AHEAD}, {q.SIGMA}, l AS (SELECT k, arg_max(y, date) AS last FROM monthly GROUP BY k), e AS (SELECT k, step, (yhat + last) / 2 AS m, abs(yhat - last) / 2 AS spread FROM ah JOIN l USING (k))
SELECT k, step, {r("m")} AS yhat, {r("greatest(0.0, m - 1.28 * (spread + sigma * sqrt(step)))")} AS lower, {r("m + 1.28 * (spread + sigma * sqrt(step))")} AS upper FROM e JOIN sig USING (k)"""
)
def ensemble_with_band(spark, d):
    m = q.monthly(spark, d)
    both = forecast.naive_last(m, K, "y", 6).unionByName(forecast.seasonal_naive(m, K, "y", 6))
    return rounded(forecast.ensemble_band(forecast.ensemble(both, K), forecast.sigma(m, K, "y"), K), "yhat", "lower", "upper").select("k", "step", "yhat", "lower", "upper")


# anomalies


@query(f"WITH {FOUND} SELECT k, date, {r('score')} AS score, anomaly_type FROM found WHERE severity = 'high' AND anomaly_type = 'Unexpected Spike' ORDER BY found.score DESC, k, date LIMIT 50")
def detected_anomalies(spark, d):
    return rounded(anomaly.selected(found(spark, d), ["k", "date"], "high", anomaly.SPIKE), "score").select("k", "date", "score", "anomaly_type")


@query(f"WITH {FOUND} SELECT k, date, severity FROM found ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, k, date LIMIT 10")
def urgent_anomalies(spark, d):
    return anomaly.most_urgent(found(spark, d), ["k", "date"]).select("k", "date", "severity")


CASES = lambda table, other: "CASE anomaly_type " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in table.items()) + f" ELSE '{other}' END"


@query(f"WITH {FOUND} SELECT k, date, {CASES(anomaly.ACTIONS, 'Investigate manually.')} AS action_recommended, CASE WHEN y = 0 THEN 'Rupture de stock confirmée' ELSE {CASES(anomaly.CAUSES, '')} END AS cause FROM found")
def anomaly_causes(spark, d):
    rows = anomaly.advised(found(spark, d)).withColumns({"has_rupture": F.col("y") == 0, "event": F.lit(None).cast("string")})
    return anomaly.explained(rows).select("k", "date", "action_recommended", "cause")


@query(f"WITH {FOUND}, ids AS (SELECT md5(k || date::VARCHAR) AS anomaly_id, severity FROM found) SELECT anomaly_id, CASE WHEN severity = 'high' THEN 'escalated' ELSE 'reviewed' END AS action FROM ids")
def anomaly_reviews(spark, d):
    ids = found(spark, d).select(F.md5(F.concat("k", F.col("date").cast("string"))).alias("anomaly_id"), "severity")
    first = ids.select("anomaly_id", F.lit("reviewed").alias("action"))
    again = ids.where("severity = 'high'").select("anomaly_id", F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit("dismissed").alias("action")), F.struct(F.lit(2).alias("n"), F.lit("escalated").alias("action")))).alias("x")).select("anomaly_id", "x.*")
    return sinks.replaced(first, again, ["anomaly_id"], "n")


# inventory


@query(f"WITH {q.RECOMMENDED} SELECT product_type, {r('lead_months')} AS lead_months, rupture_risk, overstock_risk, demand_trend, count(*) AS segments FROM rec GROUP BY ALL")
def recommendation_profiles(spark, d):
    return rounded(inventory.profiles(q.recommended(spark, d)).drop("query_text"), "lead_months")


FLAT = f"""{STOCK_FACTS}, mg AS (SELECT product_family, coalesce(nullif(trim(product_type), ''), 'UNKNOWN') AS product_type, date, sum(sales_qty + activations_qty) AS demand, sum(stock_qty) AS stock FROM facts GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY product_family, product_type ORDER BY date DESC) AS rn FROM mg),
sg AS (SELECT product_family, product_type, greatest(0.01, avg(demand)) AS avg_monthly_demand, CAST(floor(max(CASE WHEN rn = 1 THEN stock END)) AS BIGINT) AS current_stock FROM rk WHERE rn <= 3 GROUP BY ALL),
rs AS (SELECT *, CASE product_type WHEN 'SUBSCRIPTION' THEN 0.5::DOUBLE WHEN 'CPE_HARDWARE' THEN 2.0 WHEN 'SMARTPHONE_HW' THEN 1.5 ELSE 1.0 END AS lead, greatest(0.1, sqrt(6 * (round(avg_monthly_demand, 2) - avg_monthly_demand) * (round(avg_monthly_demand, 2) - avg_monthly_demand) / 5)) AS std FROM sg),
rt AS (SELECT *, CAST(ceil(1.65::DOUBLE * std * sqrt(lead)) AS BIGINT) AS ss FROM rs)"""


@query(f"WITH {FLAT} SELECT product_family, product_type, 'NATIONAL' AS governorate, current_stock, CAST(ceil(avg_monthly_demand * lead + ss) AS BIGINT) AS reorder_point, CAST(6 * trunc(round(avg_monthly_demand, 2)) AS BIGINT) + ss AS target_stock, 'STABLE' AS demand_trend FROM rt")
def restock_by_type(spark, d):
    out = inventory.restock(q.stock_facts(spark, d))
    return out.select(*q.PLACE, "current_stock", F.col("reorder_point").cast("long").alias("reorder_point"), F.col("target_stock").cast("long").alias("target_stock"), "demand_trend")


@query("SELECT s_suppkey AS product_id, n_name AS governorate, CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE s_suppkey % 50 END AS min_stock FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0")
def stock_limits(spark, d):
    rows = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("product_id"), F.col("n_name").alias("governorate"))
    now = rows.withColumn("min_stock", F.col("product_id") % 50)
    table = sinks.replaced(now, rows.where("product_id % 3 = 0").withColumn("min_stock", F.lit(7).cast("long")), ["product_id", "governorate"])
    return sinks.deleted(table, rows.where("product_id % 5 = 0"))


# promotions


@query(
    f"""WITH {q.LATER_PROMOS} SELECT promo_id, CASE """
    + " ".join(f"WHEN {q.between('promo_start', windows)} THEN '{n}'" for n, windows in q.calendar.DATED_EVENTS)
    + """ WHEN month(promo_start) = 1 AND day(promo_start) BETWEEN 9 AND 19 THEN 'revolution' WHEN (month(promo_start) = 12 AND day(promo_start) >= 28) OR (month(promo_start) = 1 AND day(promo_start) <= 7) THEN 'nouvel_an'
 WHEN month(promo_start) = 3 AND day(promo_start) BETWEEN 15 AND 25 THEN 'fete_independance' WHEN month(promo_start) = 7 AND day(promo_start) BETWEEN 21 AND 29 THEN 'fete_nationale' WHEN month(promo_start) = 9 OR (month(promo_start) = 8 AND day(promo_start) >= 16) THEN 'rentree_scolaire'
 WHEN month(promo_start) IN (6, 7) OR (month(promo_start) = 8 AND day(promo_start) <= 15) THEN 'ete' END AS event_type FROM later"""
)
def event_backfill(spark, d):
    return promo.event_of_start(q.later_promos(spark, d).withColumn("event_type", F.lit(None).cast("string"))).select("promo_id", "event_type")


SNAP_DAY = "1998-06-20"


@query(
    f"""WITH {STOCK_FACTS}, st AS (SELECT product_family, governorate, date, product_id, CASE WHEN governorate LIKE '%3' THEN 0.0 ELSE floor(stock_qty * 0.9) END AS a, sales_qty AS m FROM facts WHERE date <= DATE '{SNAP_DAY}'),
nw AS (SELECT product_family, governorate, sum(a) AS a, sum(m) AS m, count(DISTINCT product_id) AS p, max(date) AS sd FROM (SELECT *, max(date) OVER (PARTITION BY product_family, governorate) AS x FROM st) WHERE date = x GROUP BY 1, 2),
rc AS (SELECT product_category AS product_family, region_label AS governorate, count(*) AS n FROM sales WHERE sale_date <= DATE '{SNAP_DAY}' AND sale_date >= DATE '{SNAP_DAY}' - 30 GROUP BY 1, 2)
SELECT product_family, governorate, CASE WHEN a > 0 THEN a ELSE greatest(30, coalesce(n, 0) * 3) END::DOUBLE AS available_stock, CASE WHEN a > 0 THEN m ELSE coalesce(n, 0) END::DOUBLE AS avg_monthly_sales, CASE WHEN a > 0 THEN p ELSE 0 END::BIGINT AS product_count, CASE WHEN a > 0 THEN sd END AS snapshot_date,
 CASE WHEN a > 0 THEN 'fact_stock' ELSE 'estimated_from_sales' END AS source FROM nw FULL JOIN rc USING (product_family, governorate)"""
)
def stock_snapshot(spark, d):
    stock = q.stock_facts(spark, d).select("product_family", "governorate", "date", "product_id", F.when(F.col("governorate").endswith("3"), 0.0).otherwise(F.floor(F.col("stock_qty") * 0.9)).alias("available_qty"), F.col("sales_qty").alias("avg_monthly_sales"))
    sales = marts.sales(spark, d).select(F.col("product_category").alias("product_family"), F.col("region_label").alias("governorate"), "sale_date")
    return promo.stock_snapshot(stock, sales, ["product_family", "governorate"], F.lit(SNAP_DAY).cast("date"))


SIM = f"""ev AS (SELECT event_type AS service_type, CAST(ts AS DATE) AS date, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
ask AS (SELECT service_type, service_type || '-p' AS promo_id, DATE '2024-01-18' AS s, DATE '2024-01-24' AS e, 12.0::DOUBLE AS discount, max(value) * 5 AS stock FROM ev GROUP BY 1 UNION ALL SELECT 'none', 'none-p', DATE '2024-01-18', DATE '2024-01-24', 12.0, 300.0),
base AS (SELECT promo_id, service_type, s, e, stock, date, value, FALSE AS is_synthetic FROM ask JOIN ev USING (service_type) WHERE date BETWEEN s - 28 AND e + 21
 UNION ALL SELECT promo_id, service_type, s, e, stock, CAST(unnest(generate_series((s - 28)::TIMESTAMP, (e + 21)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE), stock / 30.0, TRUE FROM ask WHERE service_type = 'none'),
eff AS (SELECT *, value * CASE WHEN date BETWEEN s AND e THEN 1.2 WHEN date > e AND date <= e + 14 THEN 0.95 ELSE 1.0 END::DOUBLE AS w FROM base),
ind AS (SELECT promo_id, service_type, is_synthetic, max(stock) AS stock, avg(w) FILTER (date < s) AS before, avg(w) FILTER (date BETWEEN s AND e) AS daily, sum(w) FILTER (date BETWEEN s AND e) AS demand, stddev_pop(w) FILTER (date BETWEEN s AND e) AS std, sum(w - value) FILTER (date BETWEEN s AND e) AS more FROM eff GROUP BY 1, 2, 3),
res AS (SELECT *, {scalar.inverse_normal(0.95)!r}::DOUBLE * std * sqrt(7.0::DOUBLE) AS safety FROM ind)"""


def simulation(spark, d):
    points = event_days(spark, d).select(F.col("service_code").alias("service_type"), "date", F.col("nb_ventes").alias("value"))
    day = lambda x: F.lit(x).cast("date")
    none = lambda c: F.lit(None).cast("string").alias(c)
    asked = points.groupBy("service_type").agg((F.max("value") * 5).alias("current_stock")).unionByName(points.select(F.lit("none").alias("service_type"), F.lit(300.0).alias("current_stock")).distinct())
    asked = asked.select(F.concat("service_type", F.lit("-p")).alias("promo_id"), "service_type", none("region"), none("channel"), F.lit(12.0).alias("discount"), day("2024-01-18").alias("promo_start"), day("2024-01-24").alias("promo_end"), "current_stock")
    return asked, promo.simulated(asked, points, q.history(spark, d))


@query(
    f"""WITH {SIM} SELECT promo_id, is_synthetic, 'elasticity_table' AS uplift_source, 20.0::DOUBLE AS uplift_percent, 'revolution' AS event, {r("demand")} AS demand, {r("safety")} AS safety, {r("demand + safety - stock")} AS gap, {r("more")} AS additional_units, {r("stock / daily")} AS coverage,
 CASE WHEN stock / daily > 10.5 THEN 'low' WHEN stock / daily > 7 THEN 'medium' WHEN stock / daily > 3.5 THEN 'high' ELSE 'critical' END AS risk, CASE WHEN demand + safety - stock > 0 THEN DATE '2024-01-11' END AS order_by FROM res"""
)
def promo_simulation(spark, d):
    _, out = simulation(spark, d)
    return rounded(out, "demand", "safety", "gap", "additional_units", "coverage").select("promo_id", "is_synthetic", "uplift_source", "uplift_percent", "event", "demand", "safety", "gap", "additional_units", "coverage", "risk", "order_by")


@query(f"WITH {SIM} SELECT promo_id, 'Simulation ' || service_type || ' 2024-01-18' AS scenario_name, '2024-01-24' AS promo_end, {r('demand')} AS demand, CASE WHEN stock / daily > 10.5 THEN 'low' WHEN stock / daily > 7 THEN 'medium' WHEN stock / daily > 3.5 THEN 'high' ELSE 'critical' END AS risk FROM res ORDER BY promo_id LIMIT 20")
def scenario_list(spark, d):
    asked, out = simulation(spark, d)
    saved = promo.listed(promo.scenarios(asked, out, F.lit("2024-02-01").cast("timestamp")))
    return rounded(saved.select("promo_id", "scenario_name", F.from_json("request_params", "promo_end string")["promo_end"].alias("promo_end"), F.from_json("results", "demand double")["demand"].alias("demand"), F.from_json("results", "risk string")["risk"].alias("risk")), "demand")


@query(f"WITH {SIM} SELECT service_type, 'revolution' AS event_type, 12.0::DOUBLE AS discount_percent, 20.0::DOUBLE AS actual_uplift, {r('demand')} AS units_sold_during, {r('demand - more')} AS baseline_units_expected FROM res UNION ALL SELECT 'VOD', 'eid_fitr', 10.0, 14.0, 100.0, 90.0")
def scenario_mirror(spark, d):
    asked, out = simulation(spark, d)
    facts = promo.mirrored(asked, out).drop("region", "channel", "notes", "promo_start", "promo_end")
    seen = asked.limit(1).select(F.lit("VOD").alias("service_type"), F.lit("2024-04-12").cast("date").alias("promo_start"), F.lit("2024-04-20").cast("date").alias("promo_end"), F.lit(10.0).alias("discount_percent"), F.lit(14.0).alias("actual_uplift"), F.lit(100.0).alias("units_sold_during"), F.lit(90.0).alias("baseline_units_expected"))
    return rounded(facts.unionByName(promo.outcomes(seen).drop("promo_start", "promo_end")), "units_sold_during", "baseline_units_expected")


@query(f"WITH {q.PROMOS}, s AS (SELECT c_mktsegment AS service_code, o_orderdate::DATE AS sale_date, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey) SELECT service_code, count(*) AS n FROM s WHERE EXISTS (SELECT 1 FROM promos p WHERE p.service_code = s.service_code AND s.sale_date BETWEEN promo_start AND promo_end) GROUP BY 1")
def promo_covered_sales(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("service_code"), F.col("o_orderdate").cast("date").alias("sale_date"))
    return promo.covered(rows, q.promos(spark, d)).groupBy("service_code").agg(F.count("*").alias("n"))


# sales uploads, places, promotions of an upload, caches

UPLOAD = """up AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS line, '216' || lpad(CAST(l_orderkey * 7 AS VARCHAR), CASE WHEN l_orderkey % 10 = 0 THEN 7 ELSE 8 END, '0') AS msisdn,
 CASE WHEN l_suppkey % 20 = 0 THEN 'x' ELSE strftime(l_shipdate, '%d/%m/%Y') END AS written, ['Fibre 100', 'Fixe Jdid', 'forfait GO', 'IPTV', 'Autre', 'internet fixe'][l_partkey % 6 + 1] AS offre, 'D' || l_suppkey AS dealer FROM lineitem)"""


def upload(spark, d):
    """Order lines as a sales upload, dates day first, some numbers too short, some dates and services unreadable. Lines of several
    orders may have one number, so a line's place is that among all lines: what they are sorted by, compared field by field."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    offre = F.element_at(F.array(*map(F.lit, ("Fibre 100", "Fixe Jdid", "forfait GO", "IPTV", "Autre", "internet fixe"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    key = (F.col("l_orderkey") * 7).cast("string")
    return read(spark, d, "lineitem").select(
        F.when(F.col("l_suppkey") % 20 == 0, "x").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("CREATION_DATE"), F.concat(F.lit("216"), F.when(F.col("l_orderkey") % 10 == 0, F.lpad(key, 7, "0")).otherwise(F.lpad(key, 8, "0"))).alias("MSISDN"),
        offre.alias("OFFRE"), F.concat(F.lit("D"), "l_suppkey").alias("DEALER_CODE"), order.alias(files.LINE),
    )


SERVICE_CASE = "CASE WHEN offre LIKE 'Fibre%' THEN 'FIBRE' WHEN offre = 'Fixe Jdid' THEN '5G' WHEN offre = 'forfait GO' THEN 'DATA_BUNDLE' WHEN offre = 'IPTV' THEN 'VOD' END"


@query(
    f"""WITH {UPLOAD}, v AS (SELECT *, {SERVICE_CASE} AS service_code, strptime(written, '%d/%m/%Y') AS created_at FROM up WHERE written <> 'x' AND length(msisdn) >= 11 AND {SERVICE_CASE} IS NOT NULL)
SELECT msisdn, created_at, service_code, arg_max(dealer, line) AS dealer_id, arg_min(offre, line) AS product_id FROM v GROUP BY 1, 2, 3"""
)
def sales_ingestion(spark, d):
    rows = files.sales_frame(upload(spark, d)).select("msisdn", "created_at", "service_code", "dealer_id", "product_id", F.col("line").alias("seq"))
    return sinks.upserted(rows.limit(0), rows, sinks.SALES_KEY, ["dealer_id"]).drop("seq")


@query("SELECT n_nationkey % 3 AS kind, count(DISTINCT r_name) AS regions, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def geo_keys(spark, d):
    rows = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = rows.select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("governorate"), F.lit(None).cast("string").alias("delegation"))
    parts = ("city", "governorate", "delegation")
    geo = sinks.geo_ensured(sinks.geo_ensured(places.limit(0).select(F.lit(0).cast("long").alias("geo_id"), *parts), places), places)
    found_again = places.withColumn("geo_id", sinks.geo_key(*map(F.col, parts))).join(geo.select("geo_id"), "geo_id")
    return found_again.groupBy((F.col("n_nationkey") % 3).alias("kind")).agg(F.countDistinct("governorate").alias("regions"), F.count("*").alias("n"))


@query("SELECT o_orderkey % 50 AS cache_key, CAST(max(CASE WHEN year(o_orderdate) >= 1998 THEN 1 ELSE 0 END) AS INT) AS version FROM orders GROUP BY 1")
def forecast_cache(spark, d):
    orders = read(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("cache_key"), (F.year("o_orderdate") >= 1998).cast("int").alias("payload"))
    at = lambda x: F.lit(x).cast("timestamp")
    keys = orders.groupBy("cache_key").agg(F.max("payload").alias("payload"))
    old = sinks.cached(keys.limit(0).withColumn("expires_at", at("2024-01-01")), keys.withColumn("payload", F.lit(-1)), at("2024-01-01"))
    now = sinks.cached(old, keys, at("2024-01-02"))
    return sinks.valid(now, at("2024-01-02 12:00:00")).select("cache_key", F.col("payload").alias("version"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY GROUP BY 1")
def retention(spark, d):
    return sinks.retained(read(spark, d, "events"), "ts", F.lit("2024-01-20").cast("timestamp_ntz"), 5).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(text) AS digest FROM documents QUALIFY doc_id = min(doc_id) OVER (PARTITION BY text)")
def first_chunks(spark, d):
    return retrieval.first_of_texts(read(spark, d, "documents"), "doc_id", "text").select("doc_id", F.md5("text").alias("digest"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[_-]', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents")
def documents_normalised(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(scalar.normalised(F.col("text"))).alias("digest"))


@query("SELECT 'embedding' AS vector_field, CAST(min(len(embedding)) AS INT) AS least_dim, CAST(max(len(embedding)) AS INT) AS most_dim, 'COSINE' AS metric_type, count(*) AS row_count FROM embeddings")
def vector_collection(spark, d):
    return retrieval.described(read(spark, d, "embeddings"), "embedding")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'MULTI' WHEN 'de' THEN 'UNKNOWN' ELSE upper(lang) END AS service FROM documents WHERE lang IN ('fr', 'en', 'de') AND n_chars > 500 AND source IS NOT NULL")
def filtered_documents(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", "MULTI").when(F.col("lang") == "de", "UNKNOWN").otherwise(F.upper("lang")).alias("service"), "n_chars", "source")
    return rows.where(retrieval.of_service("fr") & retrieval.meets(expression="n_chars > 500 AND source IS NOT NULL")).select("doc_id", "service")


@query(
    f"""WITH {FUSED}, hy AS (SELECT query_id, doc_id, count(dense_rank) OVER w AS d, count(lexical_rank) OVER w AS x, fused, s AS similarity, score FROM fz LEFT JOIN dn USING (query_id, doc_id) LEFT JOIN lex USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id)),
hm AS (SELECT query_id, doc_id, CASE WHEN d > 0 AND x > 0 THEN 'hybrid' WHEN d > 0 THEN 'dense_only' ELSE 'lexical_only' END AS mode, round(CASE WHEN d > 0 AND x > 0 THEN fused WHEN d > 0 THEN similarity ELSE score END, 6) AS f FROM hy),
hc AS (SELECT * FROM hm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY f DESC, doc_id) <= 20),
ho AS (SELECT c.query_id, c.doc_id, mode, f, coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]{{2,}}')), regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'))) / nullif(len(list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]{{2,}}'))), 0)::DOUBLE, 0.0) AS overlap FROM hc c LEFT JOIN asked USING (query_id) LEFT JOIN documents USING (doc_id)),
hf AS (SELECT *, round(f + 0.2::DOUBLE * overlap, 6) AS final FROM ho)
SELECT query_id, doc_id, mode, {r("overlap")} AS overlap, {r("final")} AS final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hf.final DESC, doc_id) AS INT) AS rank FROM hf QUALIFY rank <= 5"""
)
def hybrid_retrieve(spark, d):
    vectors, docs = read(spark, d, "embeddings"), read(spark, d, "documents")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    dense_found = retrieval.dense_topk(vectors, asked, 40).withColumnRenamed("vec_id", "doc_id")
    out = retrieval.hybrid(dense_found, retrieval.lexical_topk(docs, q.questions(spark, d), 40), docs.select("doc_id", "text"), q.questions(spark, d))
    return rounded(out, "overlap", "final")


# generators

WEIGHTS = (1.0, 0.75, 0.5, 0.2, 0.4)


@query(
    f"""WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders), c AS (SELECT month, n_nationkey, p_type, {list(WEIGHTS)}[n_nationkey % 5 + 1]::DOUBLE AS weight FROM m, nation, (SELECT DISTINCT p_type FROM part)),
v AS (SELECT *, greatest(1, CAST(floor(10 * weight * pow(1.05::DOUBLE, year(month) - 1995) * CASE WHEN month(month) IN (8, 9) THEN 1.22 WHEN month(month) IN (6, 7) THEN 1.1 WHEN month(month) = 12 THEN 1.1 WHEN month(month) = 1 THEN 0.85 ELSE 1.0 END::DOUBLE + 0.5) AS INT)) AS n_rows FROM c)
SELECT month, p_type, sum(n_rows)::BIGINT AS sales, count(*) AS cells, sum(n_rows * (n_rows + 1) / 2)::BIGINT AS row_numbers FROM v GROUP BY 1, 2"""
)
def generated_sales(spark, d):
    months = read(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    places = read(spark, d, "nation").select("n_nationkey", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("n_nationkey") % 5 + 1).cast("int")).alias("weight"))
    cells = generators.spine(months, places, read(spark, d, "part").select("p_type").distinct())
    rows = generators.expanded(generators.volumes(cells, F.lit(10.0), 1.05, 1995))
    return rows.groupBy("month", "p_type").agg(F.count("*").alias("sales"), F.countDistinct("n_nationkey").alias("cells"), F.sum("row_in_month").alias("row_numbers"))
