"""Registered queries over the given tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.functions import calendar, payloads, scalar
from quaywise.functions.scalar import six
from quaywise.operators import anomaly, forecast, generators, inventory, marts, promo, retrieval, series
from quaywise.session import read
from quaywise.sources import sinks
from quaywise.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = ["k"]

SALES = """sales AS (
 SELECT CAST(o.o_orderdate AS DATE) AS sale_date, c.c_mktsegment AS service_code, coalesce(r.r_name, 'UNKNOWN') AS region_key, coalesce(n.n_name, 'UNKNOWN') AS region_label,
        l.l_suppkey AS dealer_id, coalesce(p.p_brand, 'UNKNOWN') AS offer_code, coalesce(p.p_type, 'UNKNOWN') AS product_category, p.p_retailprice AS price, l.l_partkey AS product_id,
        l.l_quantity AS qty, l.l_discount AS discount, l.l_returnflag AS returnflag, l.l_linestatus AS linestatus
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
 LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN part p ON l.l_partkey = p.p_partkey)"""
MONTHLY = SALES + """,
monthly AS (SELECT service_code AS k, CAST(date_trunc('month', sale_date) AS DATE) AS date, sum(qty) AS y FROM sales GROUP BY 1, 2)"""
DAILY = "daily AS (SELECT event_type AS k, CAST(ts AS DATE) AS date, sum(value) AS y FROM events GROUP BY 1, 2)"
STOCK = SALES + """,
moved AS (
 SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, product_category, region_label, sum(qty) AS qty,
        sum(CASE WHEN returnflag = 'N' THEN qty ELSE 0.0 END) AS received, sum(CASE WHEN returnflag <> 'N' THEN qty ELSE 0.0 END) AS sold,
        sum(CASE WHEN returnflag = 'R' THEN qty ELSE 0.0 END) AS activations
 FROM sales GROUP BY 1, 2, 3),
stock AS (SELECT *, greatest(0.0, sum(received - sold) OVER (PARTITION BY product_category, region_label ORDER BY month)) AS on_hand FROM moved)"""
RAW_MEASURES = """count(*) AS nb_ventes, count(DISTINCT dealer_id) AS nb_dealers_actifs,
 CAST(sum(CASE WHEN discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS nb_ventes_promo,
 sum(CASE WHEN discount >= 0.05 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS pct_ventes_promo, avg(price) AS prix_moyen"""
MEASURES = """count(*) AS nb_ventes, count(DISTINCT dealer_id) AS nb_dealers_actifs,
 CAST(sum(CASE WHEN discount >= 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS nb_ventes_promo,
 floor(sum(CASE WHEN discount >= 0.05 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) * 1e6 + 0.5) / 1e6 AS pct_ventes_promo,
 floor(avg(price) * 1e6 + 0.5) / 1e6 AS prix_moyen"""
#: Years by which the dates of sales are moved to lie within the calendars of events.
LATER = 25


def r(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: six(F.col(c)) for c in columns})


def monthly(spark: SparkSession, d: str) -> DataFrame:
    rows = marts.sales(spark, d)
    return rows.groupBy(F.col("service_code").alias("k"), F.trunc("sale_date", "MM").alias("date")).agg(F.sum("qty").alias("y"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.col("ts").cast("date").alias("date")).agg(F.sum("value").alias("y"))


def stock(spark: SparkSession, d: str) -> DataFrame:
    return marts.stock(marts.sales(spark, d))


# marts


@query(f"WITH {SALES} SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, service_code, region_key, product_category, {MEASURES} FROM sales GROUP BY 1, 2, 3, 4")
def monthly_sales_mart(spark, d):
    return rounded(marts.monthly_mart(marts.sales(spark, d)), "pct_ventes_promo", "prix_moyen")


@query(f"WITH {SALES} SELECT sale_date, service_code, {MEASURES} FROM sales GROUP BY 1, 2")
def daily_sales_mart(spark, d):
    return rounded(marts.daily_mart(marts.sales(spark, d)), "pct_ventes_promo", "prix_moyen")


@query(
    f"""WITH {SALES}, mart AS (SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, service_code, region_key, product_category, {RAW_MEASURES} FROM sales GROUP BY 1, 2, 3, 4)
SELECT month, CAST(sum(nb_ventes) AS BIGINT) AS nb_ventes, CAST(sum(nb_ventes_promo) AS BIGINT) AS nb_ventes_promo, {r("avg(nb_dealers_actifs)")} AS nb_dealers_actifs,
 {r("avg(pct_ventes_promo)")} AS pct_ventes_promo, {r("avg(prix_moyen)")} AS prix_moyen, min(region_key) AS region_key FROM mart GROUP BY month"""
)
def segment_reaggregate(spark, d):
    return rounded(marts.reaggregated(marts.monthly_mart(marts.sales(spark, d))), "nb_dealers_actifs", "pct_ventes_promo", "prix_moyen")


@query(f"WITH {SALES} SELECT CAST(date_trunc('month', sale_date) AS DATE) AS month, offer_code, coalesce(nullif(trim(product_category), ''), offer_code) AS category, {MEASURES} FROM sales GROUP BY 1, 2, 3")
def offer_based_source(spark, d):
    return rounded(marts.offer_mart(marts.sales(spark, d)), "pct_ventes_promo", "prix_moyen")


@query(f"WITH {SALES} SELECT DISTINCT service_code, region_key, product_category FROM sales")
def target_values(spark, d):
    return marts.sales(spark, d).select("service_code", "region_key", "product_category").distinct()


@query(f"WITH {SALES} SELECT sale_date, dealer_id, product_id, qty FROM sales WHERE lower(trim(service_code)) = 'building' AND lower(trim(region_key)) = 'europe' AND region_label ILIKE '%ion_1%'")
def filtered_sales(spark, d):
    return marts.filtered(marts.sales(spark, d), service=" Building ", region="EUROPE", contains="ion_1").select("sale_date", "dealer_id", "product_id", "qty")


@query(
    f"""WITH {STOCK} SELECT month, product_category, region_label, on_hand, on_hand < 10 AS understock_risk, on_hand > 500 AS overstock_risk, on_hand - 10 AS stock_vs_min,
 CASE WHEN on_hand <= 0 THEN 'OUT_OF_STOCK' WHEN on_hand < 10 THEN 'LOW_STOCK' WHEN on_hand > 500 THEN 'HIGH_STOCK' ELSE 'NORMAL' END AS status FROM stock"""
)
def stock_status(spark, d):
    return marts.stock_flags(stock(spark, d)).select("month", "product_category", "region_label", "on_hand", "understock_risk", "overstock_risk", "stock_vs_min", "status")


@query(
    f"""WITH {STOCK} SELECT month, product_category, sum(on_hand) AS stock_total, count(*) FILTER (on_hand <= 0) AS nb_ruptures, count(*) FILTER (on_hand < 10) AS nb_low_stock,
 {r("avg(on_hand)")} AS stock_moyen_warehouse FROM stock GROUP BY 1, 2"""
)
def stock_summary(spark, d):
    return rounded(marts.stock_summary(stock(spark, d), "product_category"), "stock_moyen_warehouse")


@query(
    f"""WITH {STOCK}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), gone AS (SELECT month, count(*) AS n FROM stock WHERE on_hand <= 0 OR floor(on_hand * 0.9) = 0 GROUP BY 1)
SELECT date, coalesce(n, 0) > 0 AS has_rupture FROM days LEFT JOIN gone ON month = CAST(date_trunc('month', date) AS DATE)"""
)
def stock_rupture_window(spark, d):
    days = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return marts.ruptures(stock(spark, d).withColumn("available", F.floor(F.col("on_hand") * 0.9).cast("double")), days)


@query(f"WITH {SALES} SELECT service_code, region_key, count(*) AS n, sum(qty) AS qty FROM sales GROUP BY ROLLUP (service_code, region_key)")
def rollup_sales(spark, d):
    return marts.sales(spark, d).rollup("service_code", "region_key").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


@query(
    f"""WITH {STOCK} SELECT product_category, region_label, month, on_hand FROM stock
QUALIFY row_number() OVER (PARTITION BY product_category, region_label ORDER BY month DESC) = 1"""
)
def latest_snapshot(spark, d):
    return series.latest(stock(spark, d), ["product_category", "region_label"], F.desc("month")).select("product_category", "region_label", "month", "on_hand")


@query(f"WITH {SALES}, t AS (SELECT max(sale_date) AS m FROM sales) SELECT service_code, count(*) AS n, sum(qty) AS qty, {r('avg(qty)')} AS mean_qty FROM sales, t WHERE sale_date > m - INTERVAL 3 MONTH GROUP BY 1")
def live_kpi_sales(spark, d):
    rows = marts.sales(spark, d)
    recent = rows.where(F.col("sale_date") > F.add_months(rows.agg(F.max("sale_date")).scalar(), -3))
    return rounded(recent.groupBy("service_code").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.avg("qty").alias("mean_qty")), "mean_qty")


@query(
    f"""WITH {STOCK}, last AS (SELECT product_category, region_label, on_hand FROM stock QUALIFY row_number() OVER (PARTITION BY product_category, region_label ORDER BY month DESC) = 1)
SELECT product_category, sum(on_hand) AS stock FROM last GROUP BY 1 ORDER BY stock DESC, product_category LIMIT 10"""
)
def live_kpi_stock(spark, d):
    last = series.latest(stock(spark, d), ["product_category", "region_label"], F.desc("month"))
    return last.groupBy("product_category").agg(F.sum("on_hand").alias("stock")).orderBy(F.desc("stock"), "product_category").limit(10)


# calendar and generators


def between(column: str, windows) -> str:
    return "(" + " OR ".join(f"{column} BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in windows) + ")"


def later_days(spark, d):
    """The distinct days of sales, moved to lie within the calendars of events."""
    return read(spark, d, "orders").select(F.add_months(F.col("o_orderdate").cast("date"), 12 * LATER).alias("date")).distinct()


LATER_DAYS = f"days AS (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + INTERVAL {LATER} YEAR AS DATE) AS date FROM orders)"


@query(
    f"""WITH {LATER_DAYS} SELECT date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
 CAST(dayofweek(date) AS INT) AS dow, CAST(quarter(date) AS INT) AS quarter, CAST(week(date) AS INT) AS week, dayofweek(date) IN (0, 6) AS is_weekend,
 month(date) * 100 + day(date) IN (101, 114, 320, 409, 501, 725, 813, 1015) AS is_holiday, {between("date", calendar.RAMADAN)} AS is_ramadan, month(date) IN (6, 7, 8) AS is_summer FROM days"""
)
def calendar_dim(spark, d):
    return calendar.describe(later_days(spark, d))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
def row_expansion(spark, d):
    units = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_partkey", F.explode(F.sequence(F.lit(1), F.col("l_quantity").cast("int"))).alias("unit"))
    return units.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("units"), F.countDistinct("l_partkey").alias("parts"))


# series


@query(
    f"""WITH {DAILY}, spine AS (SELECT k, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM daily GROUP BY k)
SELECT s.k, s.date, {r("coalesce(y, 0.0)")} AS y FROM spine s LEFT JOIN daily d ON s.k = d.k AND s.date = d.date"""
)
def gap_fill_daily(spark, d):
    return rounded(series.gap_filled(daily(spark, d), K, "y"), "y")


GAPPED = SALES + """,
part_m AS (SELECT offer_code || '|' || region_label AS k, CAST(date_trunc('month', sale_date) AS DATE) AS date, sum(qty) AS y FROM sales GROUP BY 1, 2),
spine AS (SELECT k, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS date FROM part_m GROUP BY k),
gapped AS (SELECT s.k, s.date, d.y FROM spine s LEFT JOIN part_m d ON s.k = d.k AND s.date = d.date)"""


def part_monthly(spark, d):
    rows = marts.sales(spark, d)
    return rows.groupBy(F.concat_ws("|", "offer_code", "region_label").alias("k"), F.trunc("sale_date", "MM").alias("date")).agg(F.sum("qty").alias("y"))


def gapped(spark, d):
    rows = part_monthly(spark, d)
    spine = rows.groupBy("k").agg(F.explode(F.sequence(F.min("date"), F.max("date"), F.expr("interval 1 month"))).alias("date"))
    return spine.join(rows, ["k", "date"], "left")


@query(f"WITH {GAPPED} SELECT k, date, coalesce(y, 0.0) AS y FROM gapped")
def gap_fill_monthly(spark, d):
    return series.gap_filled(part_monthly(spark, d), K, "y", "month")


@query(
    f"""WITH {GAPPED}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM gapped),
m AS (SELECT *, last_value(y IGNORE NULLS) OVER a AS p, first_value(y IGNORE NULLS) OVER b AS q, last_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi,
 first_value(CASE WHEN y IS NOT NULL THEN i END IGNORE NULLS) OVER b AS qi FROM n
 WINDOW a AS (PARTITION BY k ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY k ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT k, date, y, {r("coalesce(p, q, 0.0)")} AS filled, {r("coalesce(p + (q - p) * coalesce((i - pi) / nullif(qi - pi, 0)::DOUBLE, 0.0), p, q, 0.0)")} AS interpolated FROM m"""
)
def fill_and_interpolate(spark, d):
    return rounded(series.filled(gapped(spark, d), K, "y"), "filled", "interpolated").select("k", "date", "y", "filled", "interpolated")


@query(f"WITH {MONTHLY} SELECT k, date, y, {', '.join(f'lag(y, {n}) OVER w AS lag_{n}' for n in (1, 2, 3, 12))} FROM monthly WINDOW w AS (PARTITION BY k ORDER BY date)")
def sales_lags(spark, d):
    return series.lags(monthly(spark, d), K, "y")


@query(
    f"""WITH {MONTHLY}, f AS (SELECT *, avg(y) OVER (PARTITION BY k ORDER BY date ROWS 2 PRECEDING) AS roll_3, avg(y) OVER (PARTITION BY k ORDER BY date ROWS 5 PRECEDING) AS roll_6,
 avg(y) OVER (PARTITION BY k ORDER BY date ROWS 11 PRECEDING) AS roll_12, coalesce(stddev_samp(y) OVER (PARTITION BY k ORDER BY date ROWS 2 PRECEDING), 0.0) AS roll_std_3
 FROM monthly), g AS (SELECT *, (y - roll_3) - lag(y - roll_3) OVER (PARTITION BY k ORDER BY date) AS d FROM f)
SELECT k, date, y, {r("roll_3")} AS roll_3, {r("roll_6")} AS roll_6, {r("roll_12")} AS roll_12, {r("roll_std_3")} AS roll_std_3, {r("least(roll_std_3 / (roll_3 + 1e-6), 1.0)")} AS volatility,
 {r("y - roll_3")} AS momentum, {r("coalesce(d, 0.0)")} AS acceleration FROM g"""
)
def rolling_features(spark, d):
    return rounded(series.rolling(monthly(spark, d), K, "y"), "roll_3", "roll_6", "roll_12", "roll_std_3", "volatility", "momentum", "acceleration")


@query(
    f"""WITH {MONTHLY}, moved AS (SELECT k, CAST(date + INTERVAL {LATER} YEAR AS DATE) AS date FROM monthly) SELECT k, date, CAST(row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS INT) AS trend_index, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter,
 CAST(isodow(date) - 1 AS INT) AS day_of_week, isodow(date) >= 6 AS is_weekend, month(date) * 100 + day(date) IN (101, 114, 320, 409, 501, 725, 813, 1015) AS is_holiday, {between("date", calendar.RAMADAN)} AS is_ramadan,
 {r("sin(month(date) * (2 * pi() / 12))")} AS month_sin, {r("cos(month(date) * (2 * pi() / 12))")} AS month_cos,
 {r("sin((isodow(date) - 1) * (2 * pi() / 7))")} AS week_sin, {r("cos((isodow(date) - 1) * (2 * pi() / 7))")} AS week_cos FROM moved"""
)
def calendar_features(spark, d):
    rows = monthly(spark, d).select("k", F.add_months("date", 12 * LATER).alias("date"))
    return rounded(series.calendar_features(rows, K), "month_sin", "month_cos", "week_sin", "week_cos")


@query(
    f"""WITH {GAPPED}, z AS (SELECT k, date, CASE WHEN date >= DATE '2000-06-01' THEN 0.0 ELSE coalesce(y, 0.0) END AS y, row_number() OVER (PARTITION BY k ORDER BY date) AS i FROM gapped)
SELECT k, date, y FROM z QUALIFY i <= greatest(coalesce(max(CASE WHEN abs(y) > 1e-9 THEN i END) OVER (PARTITION BY k), 0), 6)"""
)
def trailing_zero_trim(spark, d):
    rows = series.gap_filled(part_monthly(spark, d), K, "y", "month").withColumn("y", F.when(F.col("date") >= "2000-06-01", 0.0).otherwise(F.col("y")))
    return series.trailing_zeros_cut(rows, K, "y")


@query(
    f"""WITH {MONTHLY}, q AS (SELECT k, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) AS n FROM monthly GROUP BY k),
m AS (SELECT monthly.*, q1, q3, n, median(y) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS med FROM monthly JOIN q USING (k)),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM m)
SELECT k, date, y, {r("lower")} AS lower, {r("upper")} AS upper, n >= 4 AND (y < lower OR y > upper) AS is_outlier, {r("CASE WHEN n >= 4 AND (y < lower OR y > upper) THEN med ELSE y END")} AS smoothed FROM b"""
)
def iqr_smoothed(spark, d):
    return rounded(series.outliers_smoothed(monthly(spark, d), K, "y"), "lower", "upper", "smoothed")


@query(
    f"""WITH {MONTHLY}, w AS (SELECT *, avg(y) OVER (PARTITION BY k) AS mean, coalesce(nullif(stddev_samp(y) OVER (PARTITION BY k), 0.0), 1.0) AS std FROM monthly)
SELECT k, date, y, {r("mean")} AS mean, {r("std")} AS std, {r("(y - mean) / std")} AS z, {r("greatest(0.0, (y - mean) / std * std + mean)")} AS restored FROM w"""
)
def family_znorm(spark, d):
    return rounded(series.z_normalised(monthly(spark, d), K, "y"), "mean", "std", "z", "restored")


@query(
    f"""WITH {GAPPED}, g AS (SELECT k, date, y, date_diff('day', lag(date) OVER (PARTITION BY k ORDER BY date), date) AS gap_days FROM part_m)
SELECT k, date, y, CAST(gap_days AS INT) AS gap_days FROM g WHERE gap_days > 45"""
)
def month_gaps(spark, d):
    return series.month_gaps(part_monthly(spark, d), K)


@query(f"WITH {MONTHLY}, l AS (SELECT k, y, lag(y, 12) OVER (PARTITION BY k ORDER BY date) AS b FROM monthly) SELECT k, {r('corr(y, b)')} AS autocorr, count(b) AS pairs FROM l GROUP BY k")
def autocorr_12(spark, d):
    return rounded(series.autocorrelation(monthly(spark, d), K, "y"), "autocorr")


# forecasts

SIGMA = """sig AS (SELECT k, greatest(coalesce(stddev_pop(d), 1.0), 1.0) AS sigma FROM (SELECT k, y - lag(y) OVER (PARTITION BY k ORDER BY date) AS d FROM monthly) GROUP BY k)"""


@query(
    f"""WITH {MONTHLY}, {SIGMA}, l AS (SELECT k, max(date) AS ld, arg_max(y, date) AS yhat FROM monthly GROUP BY k)
SELECT k, CAST(s AS INT) AS step, CAST(date_trunc('month', ld) + to_months(CAST(s AS INT)) AS DATE) AS date, yhat, {r("greatest(0.0, yhat - 1.28 * sigma * sqrt(s))")} AS lower, {r("yhat + 1.28 * sigma * sqrt(s)")} AS upper
FROM l JOIN sig USING (k), range(1, 7) AS t(s)"""
)
def naive_forecast(spark, d):
    m = monthly(spark, d)
    out = forecast.banded(forecast.naive_last(m, K, "y", 6), forecast.sigma(m, K, "y"), K)
    return rounded(out, "lower", "upper").select("k", "step", "date", "yhat", "lower", "upper")


@query(
    f"""WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM monthly),
l AS (SELECT k, max(date) AS ld, max(n) AS n FROM n GROUP BY k)
SELECT l.k, CAST(s AS INT) AS step, CAST(date_trunc('month', ld) + to_months(CAST(s AS INT)) AS DATE) AS date, n.y AS yhat FROM l, range(1, 13) AS t(s) JOIN n ON n.k = l.k AND n.i = l.n - 12 + (s - 1) % 12"""
)
def seasonal_naive_forecast(spark, d):
    return forecast.seasonal_naive(monthly(spark, d), K, "y", 12).select("k", "step", "date", "yhat")


WALK = """nn AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM monthly),
tt AS (SELECT *, n // 4 AS test, (i - (n - 3 * (n // 4))) // (n // 4) + 1 AS fold FROM nn WHERE i >= n - 3 * (n // 4)),
oo AS (SELECT *, n - (3 - fold + 1) * test AS origin FROM tt),
walk AS (SELECT o.k, o.fold, 'naive_last' AS model, o.i, o.y, p.y AS yhat FROM oo o JOIN nn p ON p.k = o.k AND p.i = o.origin - 1
 UNION ALL SELECT o.k, o.fold, 'seasonal_naive', o.i, o.y, p.y FROM oo o JOIN nn p ON p.k = o.k AND p.i = CASE WHEN origin >= 12 THEN origin - 12 + (o.i - origin) % 12 ELSE origin - 1 END)"""
ERRORS = """avg(abs(yhat - y)) AS mae, sqrt(avg((yhat - y) * (yhat - y))) AS rmse, avg(abs(CASE WHEN y = 0 THEN 1.0 ELSE y END - yhat) / abs(CASE WHEN y = 0 THEN 1.0 ELSE y END)) * 100 AS mape,
 avg(2 * abs(yhat - y) / CASE WHEN abs(y) + abs(yhat) = 0 THEN 1.0 ELSE abs(y) + abs(yhat) END) * 100 AS smape, coalesce(sum(abs(y - yhat)) * 100 / nullif(sum(abs(y)), 0), 0.0) AS wape,
 avg((yhat - CASE WHEN y = 0 THEN 1.0 ELSE y END) / CASE WHEN y = 0 THEN 1.0 ELSE y END) * 100 AS mpe, avg(yhat - y) AS bias, count(*) AS n"""
NAMES = ("mae", "rmse", "mape", "smape", "wape", "mpe", "bias")


@query(f"WITH {MONTHLY}, {WALK} SELECT k, CAST(fold AS BIGINT) AS fold, model, i, y, yhat FROM walk")
def walk_forward(spark, d):
    return forecast.walk_forward(monthly(spark, d), K, "y").withColumns({"fold": F.col("fold").cast("long"), "i": F.col("i").cast("long")})


@query(f"WITH {MONTHLY}, {WALK}, e AS (SELECT k, model, {ERRORS} FROM walk GROUP BY 1, 2) SELECT k, model, {', '.join(f'{r(c)} AS {c}' for c in NAMES)}, n FROM e")
def backtest_metrics(spark, d):
    return rounded(forecast.measured(forecast.walk_forward(monthly(spark, d), K, "y"), ["k", "model"]), *NAMES)


SCORED = f"""e AS (SELECT k, model, avg(y) AS mean_y, {ERRORS} FROM walk GROUP BY 1, 2),
scored AS (SELECT *, abs(bias) * 100 / greatest(1.0, mean_y) AS bias_pct, mape + 0.5 * (abs(bias) * 100 / greatest(1.0, mean_y)) AS composite,
 .40 * least(100.0, wape) / 100 + .25 * least(100.0, rmse) / 100 + .20 * least(100.0, mae) / 100 + .15 * least(100.0, smape) / 100 AS weighted FROM e)"""


def scores(spark, d):
    pairs = forecast.walk_forward(monthly(spark, d), K, "y")
    return forecast.scored(pairs.groupBy("k", "model").agg(F.avg("y").alias("mean_y"), *[c.alias(n) for n, c in forecast.errors().items()]))


@query(f"WITH {MONTHLY}, {WALK}, {SCORED} SELECT k, model, {r('bias_pct')} AS bias_pct, {r('composite')} AS composite, {r('weighted')} AS weighted FROM scored")
def model_scores(spark, d):
    return rounded(scores(spark, d).select("k", "model", "bias_pct", "composite", "weighted"), "bias_pct", "composite", "weighted")


@query(
    f"""WITH {MONTHLY}, {WALK}, {SCORED}, c AS (SELECT k, model, weighted AS score, min(weighted) OVER (PARTITION BY k) AS b, CASE model WHEN 'seasonal_naive' THEN 2 ELSE 5 END AS p FROM scored)
SELECT k, model, {r("score")} AS score FROM c WHERE score <= b * 1.1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY p, score) = 1"""
)
def near_tie_choice(spark, d):
    return rounded(forecast.near_tie_choice(scores(spark, d).select("k", "model", F.col("weighted").alias("score")), K), "score")


@query(
    f"""WITH {MONTHLY}, {WALK}, f AS (SELECT k, model, fold, sum(abs(y - yhat)) * 100 / sum(abs(y)) AS wape FROM walk GROUP BY 1, 2, 3),
w AS (SELECT *, 0.5 + (row_number() OVER (PARTITION BY k, model ORDER BY fold) - 1) / greatest(count(*) OVER (PARTITION BY k, model) - 1, 1)::DOUBLE AS w FROM f)
SELECT k, model, {r("sum(w * wape) / sum(w)")} AS score, arg_min(fold, wape)::BIGINT AS best_fold, arg_max(fold, wape)::BIGINT AS worst_fold, count(*) AS folds FROM w GROUP BY 1, 2"""
)
def recency_weighted_scores(spark, d):
    by = forecast.walk_forward(monthly(spark, d), K, "y").groupBy("k", "model", F.col("fold").cast("long").alias("fold")).agg((F.sum(F.abs(F.col("y") - F.col("yhat"))) * 100 / F.sum(F.abs("y"))).alias("wape"))
    return rounded(forecast.recency_weighted(by, ["k", "model"], "wape"), "score")


@query(
    f"""WITH {MONTHLY}, {WALK}, {SCORED}, g AS (SELECT k, max(CASE WHEN model = 'seasonal_naive' THEN composite END) AS target, max(CASE WHEN model = 'naive_last' THEN composite END) AS base FROM scored GROUP BY k)
SELECT k, {r("target")} AS target, {r("base")} AS base, {r("(base - target) * 100 / base")} AS gap_pct, CASE WHEN (base - target) * 100 / base < 2 THEN 'WEAK' WHEN (base - target) * 100 / base < 5 THEN 'MODERATE' WHEN (base - target) * 100 / base < 10 THEN 'GOOD' ELSE 'STRONG' END AS grade FROM g"""
)
def gap_to_baseline(spark, d):
    return rounded(forecast.gap_to_baseline(scores(spark, d).select("k", "model", F.col("composite").alias("score")), K, "seasonal_naive", "naive_last"), "target", "base", "gap_pct")


@query(f"WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i FROM monthly) SELECT k, floor(regr_slope(y, i) * 1e4 + 0.5) / 1e4 AS slope, floor(regr_intercept(y, i) * 1e4 + 0.5) / 1e4 AS intercept, count(*) AS n FROM n GROUP BY k")
def linear_trend(spark, d):
    four = lambda c: (F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c)
    return forecast.linear_trend(monthly(spark, d), K, "y").select("k", four("slope"), four("intercept"), "n")


@query(f"WITH {MONTHLY}, b AS (SELECT k, CAST(month(date) AS INT) AS month, avg(y) AS m FROM monthly GROUP BY 1, 2) SELECT k, month, {r('m / avg(m) OVER (PARTITION BY k)')} AS seasonal_index FROM b")
def seasonal_indices(spark, d):
    return rounded(forecast.seasonal_indices(monthly(spark, d), K, "y"), "seasonal_index")


@query(f"WITH {SALES}, t AS (SELECT region_label, sum(qty) AS total FROM sales GROUP BY 1) SELECT region_label, total, {r('total / sum(total) OVER ()')} AS share FROM t")
def region_shares(spark, d):
    return rounded(forecast.shares(marts.sales(spark, d), "region_label", "qty"), "share")


@query(
    f"""WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM monthly),
f AS (SELECT k, CAST(s AS INT) AS step, (SELECT y FROM n p WHERE p.k = o.k AND p.i = o.n - 1) AS a, (SELECT y FROM n p WHERE p.k = o.k AND p.i = o.n - 12 + (s - 1) % 12) AS b FROM (SELECT DISTINCT k, n FROM n) o, range(1, 7) AS t(s))
SELECT k, step, {r("(a + b) / 2")} AS yhat, {r("abs(a - b) / 2")} AS spread, CAST(2 AS BIGINT) AS members FROM f"""
)
def ensemble_forecast(spark, d):
    m = monthly(spark, d)
    both = forecast.naive_last(m, K, "y", 6).unionByName(forecast.seasonal_naive(m, K, "y", 6))
    return rounded(forecast.ensemble(both, K), "yhat", "spread")


@query(
    f"""WITH {MONTHLY}, n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM monthly),
x AS (SELECT a.k, a.y AS last_actual, b.y AS last_forecast FROM n a JOIN n b ON a.k = b.k AND a.i = a.n - 1 AND b.i = b.n - 12 + 5)
SELECT k, last_actual, last_forecast, {r("(last_forecast - last_actual) * 100 / greatest(1.0, abs(last_actual))")} AS change_pct, CASE WHEN last_forecast >= last_actual THEN 'hausse' ELSE 'baisse' END AS trend FROM x"""
)
def forecast_change(spark, d):
    m = monthly(spark, d)
    return rounded(forecast.change(forecast.seasonal_naive(m, K, "y", 6), m, K, "y"), "change_pct")


def cells(spark, d):
    """Monthly series of every category in every region, without gaps."""
    rows = marts.sales(spark, d).groupBy(F.concat_ws("|", "product_category", "region_label").alias("k"), F.trunc("sale_date", "MM").alias("date")).agg(F.sum("qty").alias("y"))
    return series.gap_filled(rows, K, "y", "month")


def regions(spark, d):
    """Monthly series of every region, without gaps."""
    rows = marts.sales(spark, d).groupBy(F.col("region_label").alias("k"), F.trunc("sale_date", "MM").alias("date")).agg(F.sum("qty").alias("y"))
    return series.gap_filled(rows, K, "y", "month")


@query()
def fitted_forecast(spark, d):
    return rounded(forecast.widened(forecast.fitted(regions(spark, d), K, "y", 6, sigmas=True)), "yhat", "sigma", "lower", "upper")


# anomalies

ANOMALIES = f"""w AS (SELECT *, (y - avg(y) OVER (PARTITION BY k)) / coalesce(nullif(stddev_samp(y) OVER (PARTITION BY k), 0.0), 1.0) AS z, count(*) OVER (PARTITION BY k) AS n, avg(y) OVER (PARTITION BY k) AS mean,
 coalesce((sum(y) OVER a - y) / nullif(count(y) OVER a - 1, 0)::DOUBLE, avg(y) OVER (PARTITION BY k)) AS expected FROM rows0 WINDOW a AS (PARTITION BY k ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
found AS (SELECT k, date, y, z, expected, CASE WHEN y = 0 AND expected > 0 THEN 'Data Quality Issue' WHEN z >= 1.5 THEN 'Unexpected Spike' WHEN z <= -1.5 THEN 'Unexpected Drop' ELSE 'Gradual Anomaly' END AS anomaly_type,
 CASE WHEN (y = 0 AND mean > 0) OR abs(z) >= 1.2 * 1.5 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN y = 0 AND mean > 0 THEN 0.9 ELSE least(1.0, abs(z) / 3.0) END AS score,
 coalesce((y - expected) * 100 / nullif(expected, 0), -100.0) AS variance_pct FROM w WHERE n >= 3 AND ((y = 0 AND mean > 0) OR abs(z) >= 1.5))"""


CELLS = SALES + """,
cell_m AS (SELECT product_category || '|' || region_label AS k, CAST(date_trunc('month', sale_date) AS DATE) AS date, sum(qty) AS y FROM sales GROUP BY 1, 2),
cell_s AS (SELECT k, CAST(unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS date FROM cell_m GROUP BY k),
cells AS (SELECT s.k, s.date, coalesce(c.y, 0.0) AS y FROM cell_s s LEFT JOIN cell_m c ON s.k = c.k AND s.date = c.date)"""
#: At the smallest scales many months of a cell have no sales, so the rule for these is met, too.
FOUND = f"{CELLS}, rows0 AS (SELECT * FROM cells), {ANOMALIES}"


def found(spark, d):
    return anomaly.scored(cells(spark, d), K, "y", 1.5)


@query(f"WITH {FOUND} SELECT k, date, y, {r('z')} AS z, {r('expected')} AS expected, anomaly_type, severity, {r('score')} AS score, {r('variance_pct')} AS variance_pct FROM found")
def zscore_anomalies(spark, d):
    return rounded(found(spark, d), "z", "expected", "score", "variance_pct")


@query(
    f"""WITH {DAILY}, rows0 AS (SELECT * FROM daily), {ANOMALIES} SELECT k, count(*) AS total, count(*) FILTER (severity = 'high') AS high_severity, count(*) FILTER (severity = 'medium') AS medium_severity,
 count(*) FILTER (anomaly_type = 'Unexpected Spike') AS spikes, count(*) FILTER (anomaly_type = 'Unexpected Drop') AS drops, count(*) FILTER (anomaly_type = 'Data Quality Issue') AS data_quality, 0.0::DOUBLE AS detection_accuracy_pct FROM found GROUP BY k"""
)
def anomaly_summary(spark, d):
    return anomaly.summary(anomaly.scored(daily(spark, d), K, "y", 1.5), K)


@query(
    f"""WITH {DAILY}, rows0 AS (SELECT * FROM daily), {ANOMALIES}, b AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, k DESC) = 1), t AS (SELECT date, sum(y) AS total FROM daily GROUP BY date)
SELECT t.date, {r("total")} AS total, score IS NOT NULL AS is_anomaly, anomaly_type, severity, {r("z")} AS z, {r("expected")} AS expected, {r("score")} AS score FROM t LEFT JOIN b ON t.date = b.date"""
)
def flagged_series(spark, d):
    rows = daily(spark, d)
    return rounded(anomaly.flagged(rows, anomaly.scored(rows, K, "y", 1.5), K, "y"), "total", "z", "expected", "score")


@query(
    f"""WITH {MONTHLY}, t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, avg(y) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS trend FROM monthly),
s AS (SELECT *, avg(y - trend) OVER (PARTITION BY k, i % 12) AS season FROM t)
SELECT k, date, y, {r("trend")} AS trend, {r("season")} AS season, {r("CASE WHEN n >= 25 THEN y - trend - season ELSE y END")} AS residual FROM s"""
)
def decomposed_series(spark, d):
    return rounded(anomaly.decomposed(monthly(spark, d), K, "y"), "trend", "season", "residual")


@query()
def isolation_forest(spark, d):
    rows = marts.sales(spark, d).groupBy(F.col("region_label").alias("k"), F.trunc("sale_date", "MM").alias("date")).agg(F.sum("qty").alias("y"), F.avg("price").alias("price"))
    return rounded(anomaly.isolated(anomaly.decomposed(rows, K, "y"), K, "y", "price", "residual"), "forest_score", "price", "trend", "season", "residual")


@query(
    f"""WITH {LATER_DAYS}, e AS (SELECT * FROM (VALUES """
    + ", ".join("({}, '{}', '{}')".format(i, n.replace("'", "''"), m) for i, (n, m) in enumerate(calendar.NEAREST_DAYS))
    + """) t(ord, event, md)), x AS (SELECT date, event, CAST(abs(date_diff('day', CAST(CASE WHEN length(md) = 10 THEN md ELSE year(date) || '-' || md END AS DATE), date)) AS INT) AS n, ord FROM days, e),
b AS (SELECT date, event, n FROM x WHERE n <= 15 QUALIFY row_number() OVER (PARTITION BY date ORDER BY n, ord) = 1)
SELECT days.date, b.event, b.n AS event_days FROM days LEFT JOIN b ON days.date = b.date"""
)
def nearest_event(spark, d):
    return anomaly.nearest_event(later_days(spark, d), calendar.NEAREST_DAYS)


@query(
    f"""WITH {MONTHLY}, rows0 AS (SELECT * FROM monthly), {ANOMALIES}, ids AS (SELECT md5(k || date::VARCHAR) AS anomaly_id, * FROM found)
SELECT anomaly_id, k, date FROM ids WHERE NOT (substr(anomaly_id, 1, 1) IN ('0', '1', '2', '3', '4', '5'))"""
)
def unreviewed_anomalies(spark, d):
    found = anomaly.scored(monthly(spark, d), K, "y", 1.5).select(F.md5(F.concat("k", F.col("date").cast("string"))).alias("anomaly_id"), "k", "date")
    reviews = found.select("anomaly_id", F.when(F.substring("anomaly_id", 1, 1).isin(*"012"), "reviewed").when(F.substring("anomaly_id", 1, 1).isin(*"345"), "dismissed").otherwise("confirmed").alias("action"))
    return anomaly.without_reviewed(found, reviews)


# inventory

TYPE = "CASE WHEN product_category IN ('ECONOMY', 'PROMO') THEN 'SUBSCRIPTION' WHEN product_category IN ('STANDARD', 'SMALL') THEN 'CPE_HARDWARE' WHEN product_category = 'MEDIUM' THEN 'SMARTPHONE_HW' ELSE '' END"
STOCK_FACTS = f"""{STOCK},
facts AS (SELECT month AS date, product_category AS product_id, product_category AS product_family, {TYPE} AS product_type, region_label AS governorate, on_hand % 400 AS stock_qty, sold AS sales_qty, activations AS activations_qty FROM stock)"""
SEGMENTS = f"""{STOCK_FACTS},
mg AS (SELECT product_family, coalesce(nullif(trim(product_type), ''), 'UNKNOWN') AS product_type, governorate, date, sum(sales_qty + activations_qty) AS demand FROM facts GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY product_family, product_type, governorate ORDER BY date DESC) AS rn FROM mg),
fm AS (SELECT product_family, max(date) AS md FROM facts GROUP BY 1),
ls AS (SELECT product_family, governorate, sum(stock_qty) AS stock, max(date) AS stock_date FROM facts JOIN fm USING (product_family) WHERE date = md GROUP BY ALL),
seg AS (SELECT k.product_family, k.product_type, k.governorate, greatest(0.01, avg(demand)) AS avg_monthly_demand, list(demand ORDER BY date) AS recent_demand, CAST(greatest(0, floor(coalesce(max(stock), 0))) AS BIGINT) AS current_stock, max(stock_date) AS stock_date
 FROM rk k LEFT JOIN ls ON ls.product_family = k.product_family AND ls.governorate = k.governorate WHERE rn <= 6 GROUP BY ALL)"""
RECOMMENDED = f"""{SEGMENTS},
a AS (SELECT *, recent_demand AS v, len(recent_demand) AS n, CASE product_type WHEN 'SUBSCRIPTION' THEN 0.5::DOUBLE WHEN 'CPE_HARDWARE' THEN 2.0 WHEN 'SMARTPHONE_HW' THEN 1.5 ELSE 1.0 END AS lead_months, CASE product_type WHEN 'CPE_HARDWARE' THEN 5 WHEN 'SMARTPHONE_HW' THEN 10 ELSE 1 END AS least_order,
 CASE WHEN governorate LIKE '%1' THEN 20 END AS stock_min, CASE WHEN governorate LIKE '%1' THEN 60 END AS stock_max FROM seg),
b AS (SELECT *, CASE WHEN n <= 1 THEN 0.1 ELSE greatest(0.1, sqrt(list_sum(list_transform(v, lambda x: (x - avg_monthly_demand) * (x - avg_monthly_demand))) / (n - 1))) END AS demand_std FROM a),
c AS (SELECT *, CAST(ceil(1.65::DOUBLE * demand_std * sqrt(lead_months)) AS BIGINT) AS ss0 FROM b),
e AS (SELECT *, CAST(list_sum(list_transform(v, lambda x: trunc(x))) AS BIGINT) + ss0 AS t0, greatest(ss0, coalesce(stock_min, ss0)) AS safety_stock FROM c),
f AS (SELECT *, CAST(ceil(avg_monthly_demand * lead_months + safety_stock) AS BIGINT) AS reorder_point, least(t0, coalesce(stock_max, t0)) AS target_stock,
 least(CAST(ceil(greatest(0, t0 - current_stock) / least_order::DOUBLE) AS BIGINT) * least_order, CASE WHEN stock_max IS NULL THEN 1000000000 ELSE greatest(0, stock_max - current_stock) END) AS order_qty,
 current_stock / avg_monthly_demand AS coverage_months, list_sum(list_transform(v[1:n // 2], lambda x: trunc(x))) / (n // 2) AS early, list_sum(list_transform(v[n // 2 + 1:], lambda x: trunc(x))) / (n - n // 2) AS late FROM e),
g AS (SELECT *, CASE WHEN current_stock <= reorder_point THEN 'CRITICAL' WHEN current_stock <= reorder_point * 1.5 THEN 'HIGH' WHEN current_stock <= reorder_point * 2.0 THEN 'MEDIUM' ELSE 'LOW' END AS rupture_risk FROM f),
rec AS (SELECT *, coverage_months * 30 AS days_of_supply,
 CASE WHEN target_stock <= 0 THEN 'LOW' WHEN current_stock >= target_stock * 2.0 THEN 'HIGH' WHEN current_stock >= target_stock * 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS overstock_risk,
 CASE WHEN n < 3 THEN 'STABLE' WHEN late > early * 1.1::DOUBLE THEN 'INCREASING' WHEN late < early * 0.9::DOUBLE THEN 'DECREASING' ELSE 'STABLE' END AS demand_trend,
 CASE WHEN rupture_risk = 'CRITICAL' THEN 'IMMEDIATE' WHEN rupture_risk = 'HIGH' THEN 'THIS_WEEK' WHEN order_qty > 0 OR rupture_risk = 'MEDIUM' THEN 'THIS_MONTH' ELSE 'NO_ACTION' END AS urgency FROM g)"""
GRAIN = ["product_category", "region_label"]
PLACE = ["product_family", "product_type", "governorate"]


def product_type():
    return scalar.chain([(F.col("product_category").isin("ECONOMY", "PROMO"), "SUBSCRIPTION"), (F.col("product_category").isin("STANDARD", "SMALL"), "CPE_HARDWARE"), (F.col("product_category") == "MEDIUM", "SMARTPHONE_HW")], "")


def stock_facts(spark, d):
    return stock(spark, d).select(
        F.col("month").alias("date"), F.col("product_category").alias("product_id"), F.col("product_category").alias("product_family"), product_type().alias("product_type"), F.col("region_label").alias("governorate"),
        (F.col("on_hand") % 400).alias("stock_qty"), F.col("sold").alias("sales_qty"), F.col("activations").alias("activations_qty"), F.lit(None).cast("string").alias("service_code"), F.when(F.col("real_count") > 0, "REAL").otherwise("SIMULATED").alias("data_source"),
    )


def recommended(spark, d):
    rows = inventory.demand_segments(stock_facts(spark, d), "by_governorate", 6).withColumn("forecast_series", F.col("recent_demand"))
    limits = rows.where(F.col("governorate").endswith("1")).select(*PLACE, F.lit(20).alias("stock_min"), F.lit(60).alias("stock_max"))
    return inventory.recommended(inventory.with_limits(rows, limits, PLACE))


@query(f"WITH {SEGMENTS} SELECT product_family, product_type, governorate, {r('avg_monthly_demand')} AS avg_monthly_demand, list_sum(recent_demand) AS demand_sum, current_stock, stock_date FROM seg")
def demand_segments(spark, d):
    rows = inventory.demand_segments(stock_facts(spark, d), "by_governorate", 6)
    return rounded(rows.withColumn("demand_sum", inventory.total(F.col("recent_demand"))), "avg_monthly_demand").select(*PLACE, "avg_monthly_demand", "demand_sum", "current_stock", "stock_date")


WHOLE, BROKEN = ("safety_stock", "reorder_point", "target_stock", "order_qty"), ("demand_std", "coverage_months", "days_of_supply")
LABELLED = ("rupture_risk", "overstock_risk", "demand_trend", "urgency")


@query(f"WITH {RECOMMENDED} SELECT product_family, product_type, governorate, {', '.join(f'{c}::BIGINT AS {c}' for c in WHOLE)}, {', '.join(f'{r(c)} AS {c}' for c in BROKEN)}, {', '.join(LABELLED)} FROM rec")
def stock_recommendation(spark, d):
    return rounded(recommended(spark, d), *BROKEN).select(*PLACE, *[F.col(c).cast("long").alias(c) for c in WHOLE], *BROKEN, *LABELLED)


@query(
    f"""WITH {RECOMMENDED} SELECT product_type, count(*) AS total_products, count(*) FILTER (rupture_risk = 'CRITICAL') AS critical_rupture_count, count(*) FILTER (rupture_risk = 'HIGH') AS high_rupture_count,
 count(*) FILTER (overstock_risk = 'HIGH') AS overstock_count, sum(order_qty)::BIGINT AS total_qty_to_order, count(*) FILTER (urgency = 'NO_ACTION') AS no_action_count FROM rec GROUP BY 1"""
)
def recommendation_summary(spark, d):
    return inventory.summary(recommended(spark, d), "product_type").withColumn("total_qty_to_order", F.col("total_qty_to_order").cast("long"))


@query(
    f"""WITH {RECOMMENDED}, don AS (SELECT product_type, governorate AS donor, max(current_stock - reorder_point) AS excess FROM rec WHERE rupture_risk IN ('LOW', 'MEDIUM') AND round(coverage_months, 2) > 3.0 AND current_stock > reorder_point GROUP BY 1, 2),
need AS (SELECT product_family, product_type, governorate, rupture_risk, order_qty FROM rec WHERE rupture_risk IN ('CRITICAL', 'HIGH') AND order_qty > 0),
best AS (SELECT n.*, d.donor, d.excess FROM need n LEFT JOIN don d ON n.product_type = d.product_type AND n.governorate <> d.donor QUALIFY row_number() OVER (PARTITION BY n.product_family, n.product_type, n.governorate ORDER BY d.excess DESC NULLS LAST, d.donor) = 1)
SELECT product_family, product_type, governorate, CASE WHEN donor IS NOT NULL THEN 'TRANSFERT' ELSE 'SUBSTITUTION' END AS suggestion, donor, excess::BIGINT AS excess, CASE WHEN donor IS NOT NULL THEN least(order_qty, excess)::BIGINT END AS transfer_qty
FROM best WHERE donor IS NOT NULL OR rupture_risk = 'CRITICAL'"""
)
def transfer_suggestions(spark, d):
    return inventory.transfers(recommended(spark, d)).withColumns({c: F.col(c).cast("long") for c in ("excess", "transfer_qty")})


# promotions

PROMOS = """promos AS (SELECT c_mktsegment || '-' || year(o_orderdate) || '-' || quarter(o_orderdate) AS promo_id, min(o_orderdate)::DATE AS promo_start, (min(o_orderdate)::DATE + 20) AS promo_end, c_mktsegment AS service_code
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, year(o_orderdate), quarter(o_orderdate))"""


def promos(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    by = rows.groupBy("c_mktsegment", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.min("o_orderdate").cast("date").alias("promo_start"))
    return by.select(F.concat_ws("-", "c_mktsegment", "y", "q").alias("promo_id"), "promo_start", F.date_add("promo_start", 20).alias("promo_end"), F.col("c_mktsegment").alias("service_code"))


DATED = ", ".join(f"({i}, '{n}', DATE '{a}', DATE '{b}')" for i, (n, windows) in enumerate(calendar.DATED_EVENTS) for a, b in windows)
YEARLY = ", ".join(f"({i + 3}, '{n}', '{a}', '{b}')" for i, (n, a, b) in enumerate(calendar.EVENTS))


def event_sql(years: str) -> str:
    return f"""dated AS (SELECT * FROM (VALUES {DATED}) t(p, ev, s, t)), yearly AS (SELECT * FROM (VALUES {YEARLY}) v(p, ev, a, b)),
met AS (SELECT promo_id, p, ev FROM later, dated WHERE promo_start - 14 <= t AND promo_end >= s
 UNION ALL SELECT promo_id, p, ev FROM (SELECT promo_id, promo_start, promo_end, p, ev, (y || '-' || a)::DATE AS s, ((y + CASE WHEN b < a THEN 1 ELSE 0 END) || '-' || b)::DATE AS t FROM later, yearly, (SELECT unnest({years}) AS k) yy, LATERAL (SELECT year(promo_start - 14) + k AS y)) WHERE promo_start - 14 <= t AND promo_end >= s),
tags AS (SELECT promo_id, arg_min(ev, p) AS event FROM met GROUP BY 1)"""


LATER_PROMOS = f"{PROMOS}, later AS (SELECT promo_id, service_code, CAST(promo_start + INTERVAL {LATER} YEAR AS DATE) AS promo_start, CAST(promo_end + INTERVAL {LATER} YEAR AS DATE) AS promo_end FROM promos)"


def later_promos(spark, d):
    return promos(spark, d).withColumns({c: F.add_months(c, 12 * LATER) for c in ("promo_start", "promo_end")})


@query(f"WITH {LATER_PROMOS}, {event_sql('[0, -1]')} SELECT later.promo_id, promo_start, promo_end, event FROM later LEFT JOIN tags USING (promo_id)")
def event_overlap(spark, d):
    return promo.tagged(later_promos(spark, d).drop("service_code"))


@query(f"WITH {LATER_PROMOS}, {event_sql('[0, -1, 1]')} SELECT later.promo_id, event FROM later LEFT JOIN tags USING (promo_id)")
def event_overlap_every_year(spark, d):
    return promo.tagged(later_promos(spark, d), every_year=True).select("promo_id", "event")


#: Services of the warehouse under the names of the telecom's, in order.
CODES = ("FIBRE", "5G", "DATA_BUNDLE", "VOD", "OTHER")
AS_CODE = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"


def elastic(d: str, code: str, at: int) -> str:
    """Uplift (at 0) or dip (1) of a discount and a service in SQL."""
    bands = sorted(promo.ELASTICITY, key=lambda b: b[0] is None)
    holds = lambda s, a, b: f"{d} BETWEEN {a} AND {b}" + (f" AND {code} = '{s}'" if s else "")
    return "CASE " + " ".join([f"WHEN {holds(s, a, b)} THEN {(u, p)[at]}::DOUBLE" for s, a, b, u, p in bands] + [f"WHEN {d} <= {m} THEN {(u, p)[at]}::DOUBLE" for m, u, p in promo.FALLBACK]) + f" ELSE {promo.BEYOND[at]}::DOUBLE END"


@query(
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_discount * 600 + 0.5)::DOUBLE AS pct, {AS_CODE}[l_suppkey % 5 + 1] AS service FROM lineitem)
SELECT *, {elastic("pct", "service", 0)} AS expected_uplift, {elastic("pct", "service", 1)} AS post_dip FROM l"""
)
def elasticity_lookup(spark, d):
    service = F.element_at(F.array(*map(F.lit, CODES)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.floor(F.col("l_discount") * 600 + 0.5).cast("double").alias("pct"), service.alias("service"))
    return promo.elasticity(rows, "pct", F.col("service"))


HISTORY = SALES + f""",
h0 AS (SELECT CAST(date_trunc('month', sale_date) + INTERVAL {LATER} YEAR AS DATE) AS promo_start, product_category, region_label, sum(qty) AS qty, avg(CASE WHEN discount >= 0.05 THEN discount END) * 100 AS discount_percent FROM sales GROUP BY 1, 2, 3),
h1 AS (SELECT *, (qty - base) * 100 / greatest(base, 1.0) AS actual_uplift FROM (SELECT *, avg(qty) OVER (PARTITION BY product_category, region_label) AS base FROM h0 WHERE discount_percent IS NOT NULL)),
later AS (SELECT product_category || region_label || promo_start AS promo_id, promo_start, promo_start + 20 AS promo_end FROM h1), {event_sql('[0, -1]')},
history AS (SELECT product_category AS service_type, region_label AS region, CASE WHEN month(promo_start) % 2 = 0 THEN 'web' ELSE 'shop' END AS channel, event AS event_type, promo_start, discount_percent, actual_uplift
 FROM h1 LEFT JOIN tags ON promo_id = product_category || region_label || promo_start),
asked AS (SELECT DISTINCT service_type || region AS question, service_type, CASE WHEN region NOT LIKE '%0' THEN region END AS q_region, CASE WHEN region LIKE '%2' OR region LIKE '%4' THEN 'web' END AS q_channel,
 CASE WHEN region LIKE '%4' THEN 'ramadan' WHEN region LIKE '%5' THEN 'eid_adha' WHEN region LIKE '%6' THEN 'nouvel_an' END AS q_event, CASE WHEN region LIKE '%4' THEN 4 WHEN region LIKE '%5' THEN 7 ELSE 12 END AS q_month, 7.0::DOUBLE AS q_discount FROM history)"""


def history(spark, d):
    """Campaigns of the past with a channel and an event, moved to lie within the calendars of events."""
    rows = promo.campaigns(marts.sales(spark, d)).withColumn("promo_start", F.add_months("promo_start", 12 * LATER)).withColumn("promo_end", F.date_add("promo_start", 20))
    return promo.tagged(rows).select(F.col("product_category").alias("service_type"), F.col("region_label").alias("region"), F.when(F.month("promo_start") % 2 == 0, "web").otherwise("shop").alias("channel"), F.col("event").alias("event_type"), "promo_start", "discount_percent", "actual_uplift")


def asked_of(rows):
    ends = lambda *digits: F.substring("region", -1, 1).isin(*digits)
    return rows.select("service_type", "region").distinct().select(
        F.concat("service_type", "region").alias("question"), "service_type", F.when(~ends("0"), F.col("region")).alias("region"), F.when(ends("2", "4"), "web").alias("channel"),
        F.when(ends("4"), "ramadan").when(ends("5"), "eid_adha").when(ends("6"), "nouvel_an").alias("event_type"), F.when(ends("4"), 4).when(ends("5"), 7).otherwise(12).alias("month"), F.lit(7.0).alias("discount"),
    )


SAME_REGION, SAME_CHANNEL, SEASON = "(q_region IS NULL OR region = q_region)", "(q_channel IS NULL OR channel = q_channel)", "month(promo_start) BETWEEN greatest(1, q_month - 1) AND least(12, q_month + 1)"
LEVELS = (f"event_type = q_event AND {SAME_REGION} AND {SAME_CHANNEL}", f"event_type = q_event AND {SAME_REGION}", "event_type = q_event", f"{SEASON} AND {SAME_REGION} AND {SAME_CHANNEL}", f"{SEASON} AND {SAME_REGION}", SEASON, "TRUE")


@query(
    f"""WITH {HISTORY}, hit AS (SELECT * FROM history JOIN asked USING (service_type) WHERE discount_percent BETWEEN 0 AND 14),
l AS ({" UNION ALL ".join(f"SELECT question, {k} AS level, count(*) AS matches, avg(actual_uplift) AS u FROM hit WHERE {c} GROUP BY 1" for k, c in enumerate(LEVELS, 1))})
SELECT question, CAST(level AS INT) AS level, matches, floor(u * 1e4 + 0.5) / 1e4 AS uplift FROM l QUALIFY row_number() OVER (PARTITION BY question ORDER BY matches >= 2 DESC, level) = 1"""
)
def uplift_ladder(spark, d):
    rows = history(spark, d)
    return promo.uplift_ladder(rows, asked_of(rows)).withColumn("uplift", F.floor(F.col("uplift") * 1e4 + 0.5) / 1e4)


@query(
    f"""WITH {HISTORY} SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY promo_start DESC, region, channel, discount_percent) AS INT) AS rank, region, event_type, promo_start, {r("discount_percent")} AS discount_percent
FROM history JOIN asked USING (service_type) WHERE discount_percent BETWEEN 0 AND 14 AND {SEASON} AND CASE WHEN q_event IS NOT NULL THEN event_type = q_event ELSE {SAME_REGION} END QUALIFY rank <= 5"""
)
def similar_campaigns(spark, d):
    rows = history(spark, d)
    return rounded(promo.similar(rows, asked_of(rows)).select("question", "rank", "region", "event_type", "promo_start", "discount_percent"), "discount_percent")


@query(
    f"""WITH {DAILY}, f AS (SELECT k, date, y AS demand, CASE WHEN date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN 1.2 WHEN date > DATE '2024-01-14' AND date <= DATE '2024-01-28' THEN 0.95 ELSE 1.0 END AS factor,
 CASE WHEN date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN 'promo' WHEN date > DATE '2024-01-14' AND date <= DATE '2024-01-28' THEN 'dip' ELSE 'base' END AS phase FROM daily)
SELECT k, date, phase, factor::DOUBLE AS factor, {r("demand * factor::DOUBLE")} AS with_promo FROM f"""
)
def promo_effect(spark, d):
    return rounded(in_january(daily(spark, d), 20, 0.25), "with_promo").select("k", "date", "phase", "factor", "with_promo")


def in_january(days, uplift, dip):
    """Daily demand with a promotion in the second week of the events."""
    return promo.effect(days, F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date"), F.lit(float(uplift)), F.lit(dip), "y")


@query(
    f"""WITH {DAILY}, i AS (SELECT k, avg(y) FILTER (date < DATE '2024-01-08') AS daily_before, avg(y) FILTER (p) AS daily, sum(y) FILTER (p) AS demand, stddev_pop(y) FILTER (p) AS std, max(y) * 6 AS stock FROM (SELECT *, date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AS p FROM daily) GROUP BY k),
j AS (SELECT *, {scalar.inverse_normal(0.95)!r}::DOUBLE * std * sqrt(7.0::DOUBLE) AS safety FROM i), g AS (SELECT *, demand + safety - stock AS gap, stock / daily AS coverage FROM j)
SELECT k, {r("demand")} AS demand, {r("safety")} AS safety, {r("daily * 7 + safety")} AS reorder_point, {r("gap")} AS gap, {r("coverage")} AS coverage, {r("stock / daily_before")} AS coverage_before,
 CASE WHEN coverage > 10.5 THEN 'low' WHEN coverage > 7 THEN 'medium' WHEN coverage > 3.5 THEN 'high' ELSE 'critical' END AS risk, {r("CASE WHEN gap > 0 THEN gap + safety END")} AS reorder_qty, CASE WHEN gap > 0 THEN DATE '2024-01-01' END AS order_by FROM g"""
)
def stock_indicators(spark, d):
    days = daily(spark, d).select("k", "date", F.col("y").alias("value"), (F.max("y").over(W.partitionBy("k")) * 6).alias("stock"))
    out = inventory.stock_indicators(days, K, F.col("stock"), F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date"))
    return rounded(out, "demand", "safety", "reorder_point", "gap", "coverage", "coverage_before", "reorder_qty").select("k", "demand", "safety", "reorder_point", "gap", "coverage", "coverage_before", "risk", "reorder_qty", "order_by")


@query(
    f"""WITH {PROMOS}, s AS (SELECT DISTINCT c_mktsegment AS service_code, o_orderdate::DATE AS sale_date FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT s.service_code, s.sale_date, (SELECT arg_min(promo_id, promo_start) FROM promos p WHERE p.service_code = s.service_code AND s.sale_date BETWEEN p.promo_start AND p.promo_end) AS promo_code FROM s"""
)
def promo_first_active(spark, d):
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("service_code"), F.col("o_orderdate").cast("date").alias("sale_date")).distinct()
    return promo.first_active(rows, promos(spark, d).withColumnRenamed("promo_id", "promo_code"))


# retrieval


def _dense(metric: str, similarity: str) -> None:
    def f(spark, d):
        vectors = read(spark, d, "embeddings")
        asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
        return rounded(retrieval.dense_topk(vectors, asked, 10, metric), "similarity")

    f.__name__ = f"dense_topk_{metric}"
    query(
        f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, {similarity} AS similarity FROM v, v q WHERE q.vec_id % 20 = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM s) SELECT query_id, vec_id, {r("similarity")} AS similarity, rank FROM t WHERE rank <= 10"""
    )(f)


_dense("cosine", "list_cosine_similarity(v.e, q.e)")
_dense("ip", "list_inner_product(v.e, q.e)")
_dense("l2", "-list_distance(v.e, q.e)")


TERMS = """asked AS (SELECT item_id AS query_id, text AS query_text FROM benchmark),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]{2,}')) AS term FROM asked),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM documents) GROUP BY 1, 2),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS mean FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY 1, 2),
lex AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM bm)"""


def questions(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


@query(f"WITH {TERMS} SELECT query_id, doc_id, rank, {r('score')} AS score FROM lex WHERE rank <= 40")
def lexical_topk(spark, d):
    return rounded(retrieval.lexical_topk(read(spark, d, "documents"), questions(spark, d), 40), "score")


FUSED = f"""{TERMS},
dn AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0),
den AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS dense_rank FROM dn QUALIFY dense_rank <= 40),
fz AS (SELECT query_id, doc_id, CAST(dense_rank AS INT) AS dense_rank, CAST(rank AS INT) AS lexical_rank, coalesce(0.6::DOUBLE / (60 + dense_rank), 0.0) + coalesce(0.4::DOUBLE / (60 + rank), 0.0) AS fused FROM den FULL JOIN (SELECT * FROM lex WHERE rank <= 40) USING (query_id, doc_id))"""


def fused(spark, d):
    vectors = read(spark, d, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    dense = retrieval.dense_topk(vectors, asked, 40).withColumnRenamed("vec_id", "doc_id")
    return retrieval.fused(dense, retrieval.lexical_topk(read(spark, d, "documents"), questions(spark, d), 40))


@query(f"WITH {FUSED} SELECT query_id, doc_id, dense_rank, lexical_rank, {r('fused')} AS fused FROM fz")
def weighted_rrf(spark, d):
    return rounded(fused(spark, d), "fused")


@query(
    f"""WITH {FUSED}, ov AS (SELECT f.query_id, f.doc_id, fused, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]{{2,}}')) AS q, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS t FROM fz f JOIN asked USING (query_id) JOIN documents USING (doc_id)),
o2 AS (SELECT query_id, doc_id, fused, coalesce(len(list_intersect(q, t)) / nullif(len(q), 0)::DOUBLE, 0.0) AS overlap FROM ov)
SELECT query_id, doc_id, {r("overlap")} AS overlap, {r("fused + 0.2::DOUBLE * overlap")} AS final FROM o2"""
)
def overlap_rerank(spark, d):
    rows = fused(spark, d).join(questions(spark, d), "query_id").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rounded(retrieval.overlap_reranked(rows, "query_text", "text"), "overlap", "final").select("query_id", "doc_id", "overlap", "final")


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS item, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0),
e AS (SELECT q.vec_id AS query_id, v.vec_id AS item FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 20 = 0),
h AS (SELECT query_id, count(*) AS hits FROM s JOIN e USING (query_id, item) WHERE rank <= 10 GROUP BY 1), z AS (SELECT query_id, count(*) AS size FROM e GROUP BY 1)
SELECT {r("avg(coalesce(hits, 0) / size::DOUBLE)")} AS recall, count(*) AS queries FROM z LEFT JOIN h USING (query_id)"""
)
def recall_at_10(spark, d):
    vectors = read(spark, d, "embeddings")
    asked = vectors.where("vec_id % 20 = 0")
    found = retrieval.dense_topk(vectors, asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10).withColumnRenamed("vec_id", "item")
    labels = vectors.select(F.col("vec_id").alias("item"), "label")
    return rounded(retrieval.label_recall(found, asked.select(F.col("vec_id").alias("query_id"), "label"), labels, 10), "recall")


@query("SELECT pos::INT AS pos, vec_id, label FROM (VALUES (0, 17), (1, 3), (2, 99999), (3, 42), (4, 8)) t(pos, id) JOIN embeddings ON vec_id = id")
def fetch_by_ids(spark, d):
    return retrieval.fetched(read(spark, d, "embeddings"), [17, 3, 99999, 42, 8])


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(0, greatest(0, len(ws) - 65) + 1, 256)) AS st FROM w WHERE len(ws) > 0)
SELECT doc_id, CAST(st // 256 AS INT) AS chunk_index, array_to_string(ws[st + 1:st + 320], ' ') AS chunk FROM s"""
)
def sliding_chunks(spark, d):
    return retrieval.sliding_chunks(read(spark, d, "documents"))


#: Chunks state by state: a row for each piece of a block, with the words and parts held behind it and the chunks that it ends.
CHUNKS = r"""WITH RECURSIVE raw AS (SELECT doc_id, source, regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n\s*\n+') AS bs FROM documents),
cut AS (SELECT doc_id, source, generate_subscripts(bs, 1) AS i, trim(regexp_replace(unnest(bs), '\s+', ' ', 'g')) AS b FROM raw),
h AS (SELECT *, len(regexp_split_to_array(b, ' ')) <= 14 AND (b LIKE '#%' OR regexp_matches(b, '^\d+(\.\d+)*[).]?\s+') OR b LIKE '%:'
 OR (regexp_replace(b, '[^A-Za-z]', '', 'g') = upper(regexp_replace(b, '[^A-Za-z]', '', 'g')) AND length(regexp_replace(b, '[^A-Za-z]', '', 'g')) >= 4)) AS head FROM cut WHERE b <> ''),
m AS (SELECT *, coalesce(lag(head) OVER w, false) AS after_head, lag(b) OVER w AS before, coalesce(lead(head) OVER w, true) AS alone FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
blocks AS (SELECT doc_id, source, i, regexp_split_to_array(CASE WHEN NOT head AND after_head THEN before || ' ' || b ELSE b END, ' ') AS ws FROM m WHERE NOT head OR alone),
pieces AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i, st) AS n, ws[st + 1:st + 320] AS w FROM (SELECT *, unnest(range(0, len(ws), 320)) AS st FROM blocks)),
s AS (SELECT doc_id, source, 0::BIGINT AS n, []::VARCHAR[] AS words, '' AS parts, NULL::VARCHAR AS ended, NULL::VARCHAR AS ended_too FROM pieces WHERE n = 1
 UNION ALL SELECT doc_id, source, n, CASE WHEN len(w2) >= 320 THEN w2[len(w2) - 63:] ELSE w2 END, CASE WHEN len(w2) >= 320 THEN array_to_string(w2[len(w2) - 63:], ' ') ELSE p2 END, ended, CASE WHEN len(w2) >= 320 THEN p2 END
 FROM (SELECT doc_id, source, n, ended, list_concat(w1, w) AS w2, CASE WHEN p1 = '' THEN '' ELSE p1 || chr(10) || chr(10) END || array_to_string(w, ' ') AS p2
 FROM (SELECT s.doc_id, s.source, p.n, p.w, CASE WHEN spill THEN words[greatest(1, len(words) - 63):] ELSE words END AS w1, CASE WHEN spill THEN array_to_string(words[greatest(1, len(words) - 63):], ' ') ELSE parts END AS p1, CASE WHEN spill THEN parts END AS ended
 FROM (SELECT s.*, p.n AS pn, len(words) > 0 AND len(words) + len(p.w) > 320 AS spill FROM s JOIN pieces p ON p.doc_id = s.doc_id AND p.n = s.n + 1) s JOIN pieces p ON p.doc_id = s.doc_id AND p.n = s.pn))),
chunks AS (SELECT doc_id, source, n, 1 AS o, ended AS chunk FROM s UNION ALL SELECT doc_id, source, n, 2, ended_too FROM s UNION ALL SELECT doc_id, source, n, 3, parts FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) = 1)),
once AS (SELECT * FROM chunks WHERE chunk <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(chunk) ORDER BY n, o) = 1)
SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, o) - 1 AS INT) AS chunk_index, chunk FROM once"""


@query(CHUNKS)
def chunk_documents(spark, d):
    return retrieval.chunked(read(spark, d, "documents"))


@query("SELECT md5(lower(trim(text))) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return retrieval.duplicate_texts(read(spark, d, "documents"))


@query(
    "SELECT role, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{x}')" for x in w) + f" THEN '{n}'" for n, w in retrieval.INTENTS.items())
    + " ELSE 'general' END AS intent, count(*) AS n FROM conversations GROUP BY 1, 2"
)
def intent_counts(spark, d):
    return read(spark, d, "conversations").groupBy("role", retrieval.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


# ingestion, mutations, audits, streams


@query(
    """WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_shipdate, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_shipdate, l_extendedprice, l_discount, l_tax) AS i FROM lineitem)
SELECT l_orderkey, l_partkey, arg_min(l_suppkey, i) AS l_suppkey, arg_max(l_quantity, i) AS l_quantity FROM t GROUP BY 1, 2"""
)
def sales_upsert(spark, d):
    order = F.row_number().over(W.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice", "l_discount", "l_tax"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", order.alias("seq"))
    return sinks.upserted(rows.where("seq = 1"), rows.where("seq > 1"), ["l_orderkey", "l_partkey"], ["l_quantity"]).drop("seq")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def insert_ignore(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return sinks.inserted(rows.where("c_custkey % 3 = 0"), rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))), ["c_custkey"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey FROM supplier")
def dimension_merge(spark, d):
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    new = rows.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).alias("s_name"), F.lit(None).cast("int").alias("s_nationkey"))
    return sinks.dimension_merged(rows, new, "s_suppkey")


@query(
    "SELECT service, tier, count(*) AS n FROM (SELECT CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(upper(p_name), '{w}')" for w in words) + f" THEN '{n}'" for n, words in scalar.SERVICES.items())
    + " ELSE 'UNKNOWN' END AS service, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(upper(p_type || ' ' || p_size * 10), '{w}')" for w in words) + f" THEN '{n}'" for n, words in scalar.TIERS.items())
    + " ELSE 'Service' END AS tier FROM part) GROUP BY 1, 2"
)
def service_tier_counts(spark, d):
    return read(spark, d, "part").groupBy(scalar.service_of(F.col("p_name")).alias("service"), scalar.tier_of(F.concat_ws(" ", "p_type", F.col("p_size") * 10)).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN m LIKE '216%' THEN length(m) >= 11 ELSE length(m) >= 8 END AS valid, count(*) AS n FROM (SELECT regexp_replace(CASE WHEN o_orderkey % 3 = 0 THEN '216' ELSE '' END || (o_custkey * 7919 * (o_orderkey % 1000)), '[^0-9]', '', 'g') AS m FROM orders) GROUP BY 1")
def msisdn_valid(spark, d):
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "216").otherwise(""), (F.col("o_custkey") * 7919 * (F.col("o_orderkey") % 1000)).cast("string"))
    return read(spark, d, "orders").groupBy(scalar.valid_msisdn(text).alias("valid")).agg(F.count("*").alias("n"))


@query("SELECT CAST(json_extract(props, '$.k') AS INT) AS key, count(*) AS n, floor(sum(value) * 1e4 + 0.5) / 1e4 AS total FROM events GROUP BY 1")
def json_props(spark, d):
    return read(spark, d, "events").groupBy(F.from_json("props", "k int")["k"].alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).withColumn("total", F.floor(F.col("total") * 1e4 + 0.5) / 1e4)


@query(
    f"""WITH {MONTHLY} SELECT k, count(*) AS length, min(date) AS first_date, max(date) AS last_date, {r("avg(y)")} AS mean, median(y) AS median, {r("stddev_samp(y)")} AS std, {r("stddev_samp(y) / avg(y)")} AS cv,
 {r("count(*) FILTER (y = 0) * 100.0::DOUBLE / count(*)")} AS pct_zero FROM monthly GROUP BY k"""
)
def series_audit(spark, d):
    y = F.col("y")
    out = monthly(spark, d).groupBy("k").agg(F.count("*").alias("length"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg(y).alias("mean"), F.median(y).alias("median"), F.stddev_samp(y).alias("std"), (F.stddev_samp(y) / F.avg(y)).alias("cv"), scalar.ratio(F.count_if(y == 0) * 100, F.count("*")).alias("pct_zero"))
    return rounded(out, "mean", "std", "cv", "pct_zero")


@query("SELECT count(*) AS rows_all, count(text) AS with_text, count(lang) AS with_lang, count(source) AS with_source, count(DISTINCT md5(text)) AS texts FROM documents")
def coverage_audit(spark, d):
    return read(spark, d, "documents").agg(F.count("*").alias("rows_all"), F.count("text").alias("with_text"), F.count("lang").alias("with_lang"), F.count("source").alias("with_source"), F.countDistinct(F.md5("text")).alias("texts"))


@query(f"SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, {r('sum(value)')} AS total FROM events GROUP BY 1, 2")
def event_daily(spark, d):
    return rounded(streams.daily(read(spark, d, "events")), "total")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def event_sessions(spark, d):
    return streams.sessions(read(spark, d, "events"))


@query()
def model_zoo_scores(spark, d):
    pairs = forecast.backtested(regions(spark, d), K, "y")
    both = pairs.unionByName(forecast.walk_forward(regions(spark, d), K, "y").withColumns({"fold": F.col("fold").cast("int"), "i": F.col("i").cast("int")}))
    rows = forecast.scored(both.groupBy("k", "model").agg(F.avg("y").alias("mean_y"), *[c.alias(n) for n, c in forecast.errors().items()]))
    return rounded(rows.select("k", "model", "mae", "wape", "composite", "weighted"), "mae", "wape", "composite", "weighted")


@query()
def weighted_ensemble(spark, d):
    m = regions(spark, d)
    pairs = forecast.backtested(m, K, "y")
    errors = forecast.scored(pairs.groupBy("k", "model").agg(F.avg("y").alias("mean_y"), *[c.alias(n) for n, c in forecast.errors().items()])).select("k", "model", F.col("composite").alias("score"))
    return rounded(forecast.weighted_ensemble(forecast.fitted(m, K, "y", 6), errors, K), "yhat")


@query()
def stl_anomalies(spark, d):
    return rounded(anomaly.scored(anomaly.stl(cells(spark, d), K, "y"), K, "y", 2.5, "residual"), "residual", "z", "expected", "score", "variance_pct")


@query()
def synthetic_history(spark, d):
    return rounded(generators.synthetic_history(stock(spark, d), GRAIN), "sold", "on_hand", "received")


TYPO = "CASE WHEN c_custkey % 4 = 0 THEN lower(n_name) ELSE lower(substr(n_name, 1, c_custkey % length(n_name)) || CASE WHEN c_custkey % 4 = 1 THEN 'x' ELSE '' END || substr(n_name, c_custkey % length(n_name) + 2)) END"


@query(
    f"""WITH q AS (SELECT DISTINCT {TYPO} AS asked FROM customer JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT asked, n_name, trim(replace(asked, '_', ' ')) AS a, trim(replace(lower(n_name), '_', ' ')) AS b FROM q, nation),
s AS (SELECT asked, n_name, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE AS s FROM n)
SELECT q.asked, m.n_name AS matched, {r("m.s")} AS similarity FROM q LEFT JOIN (SELECT * FROM s WHERE s >= 0.75 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY s DESC, n_name) = 1) m ON q.asked = m.asked"""
)
def fuzzy_members(spark, d):
    nation = read(spark, d, "nation")
    rows = read(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = rows.select(F.expr(TYPO).alias("asked")).distinct()
    return rounded(payloads.nearest(asked, "asked", nation.select(F.col("n_name").alias("matched")), "matched"), "similarity")


ASOF_PRICE = f"""WITH {SALES}, p AS (SELECT product_category, CAST(date_trunc('month', sale_date) AS DATE) AS month, avg(price) AS price FROM sales GROUP BY 1, 2),
s AS (SELECT DISTINCT product_category, sale_date FROM sales)
SELECT s.product_category, s.sale_date, {r("p.price")} AS price FROM s ASOF JOIN p ON s.product_category = p.product_category AND s.sale_date >= p.month"""


@query(ASOF_PRICE)
def asof_price(spark, d):
    """The newest monthly price of the category for each distinct category and sale day."""
    rows = marts.sales(spark, d)
    price = rows.groupBy("product_category", F.trunc("sale_date", "MM").alias("date")).agg(F.avg("price").alias("price"))
    asked = rows.select("product_category", F.col("sale_date").alias("date")).distinct().withColumn("price", F.lit(None).cast("double"))
    both = price.withColumn("_q", F.lit(0)).unionByName(asked.withColumn("_q", F.lit(1)))
    last = F.last("price", ignorenulls=True).over(W.partitionBy("product_category").orderBy("date", "_q"))
    return rounded(both.withColumn("price", last).where("_q = 1 and price is not null").select("product_category", F.col("date").alias("sale_date"), "price"), "price")


@query(ASOF_PRICE)
def asof_price_all_days(spark, d):
    """The same; kept under the name that it had while asof_price took one day of a month."""
    return asof_price(spark, d)


@query(f"WITH {SALES} SELECT service_code, region_key, returnflag, count(*) AS n FROM sales GROUP BY CUBE (service_code, region_key, returnflag)")
def cube_sales(spark, d):
    return marts.sales(spark, d).cube("service_code", "region_key", "returnflag").agg(F.count("*").alias("n"))


@query(
    f"""WITH {MONTHLY}, total AS (SELECT date, sum(y) AS y FROM monthly GROUP BY date)
SELECT date, 'historical' AS type, y AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper, NULL::VARCHAR AS model FROM total
UNION ALL SELECT CAST(max(date) + to_months(CAST(s AS INT)) AS DATE), 'forecast', arg_max(y, date), NULL, NULL, 'naive_last' FROM total, range(1, 4) AS t(s) GROUP BY s"""
)
def export_rows(spark, d):
    m = monthly(spark, d).groupBy("date").agg(F.sum("y").alias("y")).withColumn("k", F.lit("all"))
    ahead = forecast.naive_last(m, K, "y", 3).withColumns({"lower": F.lit(None).cast("double"), "upper": F.lit(None).cast("double")})
    return sinks.exported(m.withColumnRenamed("y", "value"), ahead)


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(strip_accents(lower(p_name)), '[_-]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def text_normalise(spark, d):
    return read(spark, d, "part").select("p_partkey", scalar.normalised(F.col("p_name")).alias("name"))


@query(f"WITH {SALES}, c AS (SELECT region_label, service_code, count(*) AS n FROM sales GROUP BY 1, 2) SELECT region_label, service_code AS dominant, n FROM c QUALIFY row_number() OVER (PARTITION BY region_label ORDER BY n DESC, service_code) = 1")
def dominant_service(spark, d):
    counts = marts.sales(spark, d).groupBy("region_label", "service_code").agg(F.count("*").alias("n"))
    return series.latest(counts, ["region_label"], F.desc("n"), F.col("service_code")).select("region_label", F.col("service_code").alias("dominant"), "n")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, rpad(strftime(o_orderdate, '%B'), 9, ' ') AS month_name, rpad(strftime(o_orderdate, '%A'), 9, ' ') AS day_name FROM orders")
def calendar_names(spark, d):
    days = read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return days.select("date", F.rpad(F.date_format("date", "MMMM"), 9, " ").alias("month_name"), F.rpad(F.date_format("date", "EEEE"), 9, " ").alias("day_name"))


@query("SELECT n_name, string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment) AS services FROM (SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY n_name")
def services_by_region(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ").alias("services"))


@query(f"WITH {STOCK} SELECT month, region_label, sum(on_hand) AS stock, sum(received) AS received, sum(sold) AS sold, sum(activations) AS activations, count(*) FILTER (on_hand <= 0) AS ruptures FROM stock GROUP BY 1, 2")
def stock_by_region(spark, d):
    return stock(spark, d).groupBy("month", "region_label").agg(F.sum("on_hand").alias("stock"), F.sum("received").alias("received"), F.sum("sold").alias("sold"), F.sum("activations").alias("activations"), F.count_if(F.col("on_hand") <= 0).alias("ruptures"))


@query(f"WITH {STOCK} SELECT month, product_category, sum(on_hand) AS stock, sum(sold) AS sold, sum(on_hand) - lag(sum(on_hand)) OVER (PARTITION BY product_category ORDER BY month) AS change FROM stock GROUP BY 1, 2")
def stock_trend(spark, d):
    rows = stock(spark, d).groupBy("month", "product_category").agg(F.sum("on_hand").alias("stock"), F.sum("sold").alias("sold"))
    return rows.withColumn("change", F.col("stock") - F.lag("stock").over(W.partitionBy("product_category").orderBy("month")))


@query(f"WITH {SALES} SELECT service_code, {r('quantile_cont(price, 0.1)')} AS p10, {r('quantile_cont(price, 0.5)')} AS p50, {r('quantile_cont(price, 0.9)')} AS p90 FROM sales GROUP BY 1")
def price_quantiles(spark, d):
    out = series.quantiles(marts.sales(spark, d), ["service_code"], "price", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return rounded(out, "p10", "p50", "p90")


@query(f"WITH {SALES} SELECT region_key, min(sale_date) AS first_day, max(sale_date) AS last_day, count(DISTINCT sale_date) AS days, count(DISTINCT product_id) AS products FROM sales GROUP BY 1")
def covered_period(spark, d):
    return marts.sales(spark, d).groupBy("region_key").agg(F.min("sale_date").alias("first_day"), F.max("sale_date").alias("last_day"), F.countDistinct("sale_date").alias("days"), F.countDistinct("product_id").alias("products"))


@query(
    f"""WITH {MONTHLY}, q AS (SELECT k, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM monthly GROUP BY k)
SELECT k, count(*) AS rows_all, count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)) AS outliers FROM monthly JOIN q USING (k) GROUP BY k"""
)
def sparsity_audit(spark, d):
    rows = series.outliers_smoothed(monthly(spark, d), K, "y")
    return rows.groupBy("k").agg(F.count("*").alias("rows_all"), F.count_if(F.col("y") == 0).alias("zeros"), F.count_if("is_outlier").alias("outliers"))


@query(
    f"""WITH {MONTHLY}, l AS (SELECT k, max(date) AS ld, arg_max(y, date) AS yhat FROM monthly GROUP BY k)
SELECT CAST(s AS INT) AS step, sum(yhat) AS global_forecast, count(*) AS families FROM l, range(1, 7) AS t(s) GROUP BY s"""
)
def global_forecast(spark, d):
    return forecast.naive_last(monthly(spark, d), K, "y", 6).groupBy("step").agg(F.sum("yhat").alias("global_forecast"), F.count("*").alias("families"))


SCENARIOS = (("mild", 10.0, 0.20), ("usual", 20.0, 0.25), ("strong", 45.0, 0.35))


@query(
    f"""WITH {DAILY}, sc AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {u}::DOUBLE, {p}::DOUBLE)" for n, u, p in SCENARIOS)}) t(scenario, u, p)),
f AS (SELECT scenario, k, y, y * CASE WHEN date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN 1 + u / 100 WHEN date > DATE '2024-01-14' AND date <= DATE '2024-01-28' THEN greatest(0.5, 1 - u / 100 * p) ELSE 1.0 END AS w FROM daily, sc)
SELECT scenario, k, {r("sum(y)")} AS base, {r("sum(w)")} AS with_promo FROM f GROUP BY 1, 2"""
)
def scenario_compare(spark, d):
    days, out = daily(spark, d), None
    for name, uplift, dip in SCENARIOS:
        rows = in_january(days, uplift, dip).withColumn("scenario", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return rounded(out.groupBy("scenario", "k").agg(F.sum("y").alias("base"), F.sum("with_promo").alias("with_promo")), "base", "with_promo")


@query(
    f"""WITH {FUSED}, g AS (SELECT query_id, doc_id, fused, coalesce(0.65::DOUBLE / (60 + dense_rank), 0.0) + coalesce(0.35::DOUBLE / (60 + lexical_rank), 0.0) AS old FROM fz),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 9) DESC, doc_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY round(old, 9) DESC, doc_id) AS b FROM g)
SELECT query_id, count(*) FILTER (a <= 5 AND b <= 5) AS shared_top5, min(CASE WHEN b = 1 THEN a END)::INT AS rank_of_old_first FROM k GROUP BY query_id"""
)
def weight_comparison(spark, d):
    rows = fused(spark, d)
    old = F.coalesce(F.lit(0.65) / (60 + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(F.lit(0.35) / (60 + F.col("lexical_rank")), F.lit(0.0))
    rank = lambda c: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round(c, 9)), "doc_id"))
    rows = rows.withColumn("old", old).withColumns({"a": rank("fused"), "b": rank("old")})
    return rows.groupBy("query_id").agg(F.count_if((F.col("a") <= 5) & (F.col("b") <= 5)).alias("shared_top5"), F.min(F.when(F.col("b") == 1, F.col("a"))).alias("rank_of_old_first"))


@query(
    f"""WITH {FUSED}, ov AS (SELECT f.query_id, fused + 0.2::DOUBLE * coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]{{2,}}')), regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'))) / nullif(len(list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]{{2,}}'))), 0)::DOUBLE, 0.0) AS final
 FROM fz f JOIN asked USING (query_id) JOIN documents USING (doc_id))
SELECT query_id, {r("max(final)")} AS top_score, max(final) >= 0.40 AS answered FROM ov GROUP BY query_id"""
)
def confidence_guard(spark, d):
    rows = fused(spark, d).join(questions(spark, d), "query_id").join(read(spark, d, "documents").select("doc_id", "text"), "doc_id")
    top = retrieval.overlap_reranked(rows, "query_text", "text").groupBy("query_id").agg(F.max("final").alias("top_score"))
    return rounded(top.withColumn("answered", F.col("top_score") >= retrieval.LEAST_SCORE), "top_score")


@query(
    """SELECT event_type, window_start, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS window_start FROM events) GROUP BY 1, 2"""
)
def event_sliding(spark, d):
    rows = read(spark, d, "events").groupBy("event_type", F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("window.start").alias("window_start"), "n")


def scored_sql(residual: str) -> str:
    return f"""SELECT k, date, least(1.0, abs(z) / 3.0) AS score0, y = 0 AND mean > 0 AS zero FROM (SELECT k, date, y, ({residual} - avg({residual}) OVER w) / coalesce(nullif(stddev_samp({residual}) OVER w, 0.0), 1.0) AS z, count(*) OVER w AS n, avg(y) OVER w AS mean FROM dec WINDOW w AS (PARTITION BY k)) WHERE n >= 3 AND ((y = 0 AND mean > 0) OR abs(z) >= 1.5)"""


@query(
    f"""WITH {CELLS}, t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, avg(y) OVER (PARTITION BY k ORDER BY date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS trend FROM cells),
u AS (SELECT *, avg(y - trend) OVER (PARTITION BY k, i % 12) AS season FROM t), dec AS (SELECT k, date, y, CASE WHEN n >= 25 THEN y - trend - season ELSE y END AS residual FROM u),
one AS (SELECT k, date, CASE WHEN zero THEN 0.9 ELSE score0 END AS s FROM ({scored_sql("y")})), two AS (SELECT k, date, CASE WHEN zero THEN 0.9 ELSE score0 END AS s FROM ({scored_sql("residual")}))
SELECT k, date, {r("greatest(one.s, two.s)")} AS score, CASE WHEN one.s IS NULL THEN 'residual' WHEN two.s > one.s THEN 'combined' ELSE 'raw' END AS method FROM one FULL JOIN two USING (k, date)"""
)
def anomaly_merge(spark, d):
    rows = cells(spark, d)
    named = lambda df, m: df.select("k", "date", "score", F.lit(m).alias("method"))
    return rounded(anomaly.merged(named(anomaly.scored(rows, K, "y", 1.5), "raw"), named(anomaly.scored(anomaly.decomposed(rows, K, "y"), K, "y", 1.5, "residual"), "residual"), K), "score")
