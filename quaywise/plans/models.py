"""Registered queries of models that are fitted by aggregation over all series."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaywise.operators import anomaly, boosting, forecast, forest, marts, regression, series, stock_forecast
from quaywise.plans.queries import GAPPED, K, part_monthly, query, r, rounded
from quaywise.session import cut


def monthly_parts(spark, d):
    """Monthly series of every offer and region, without gaps. Sales are joined and summed once: there are few months, and models
    go over them many times."""
    return series.gap_filled(cut(part_monthly(spark, d)), K, "y", "month")


@query()
def regression_forecast(spark, d):
    return rounded(forecast.widened(regression.forecast(monthly_parts(spark, d), K, 6)), "yhat", "sigma", "lower", "upper")


@query()
def regression_importance(spark, d):
    """The features that weigh most in each series' regression."""
    coefs = regression.coefficients(regression.frame(monthly_parts(spark, d), K), K)
    rows = coefs.select("k", F.posexplode("coef").alias("_i", "c")).withColumn("feature", F.get(F.array(*map(F.lit, regression.FEATURES)), F.col("_i")))
    return rounded(forecast.importances(rows.where("_i > 0").select("k", "feature", F.abs("c").alias("importance")), K), "importance", "normalized_importance")


@query()
def regression_scores(spark, d):
    """Walk-forward errors of the regression next to those of the naive models, ranked by composite score."""
    dense = monthly_parts(spark, d)
    kinds = {"fold": F.col("fold").cast("int"), "i": F.col("i").cast("int")}
    pairs = regression.backtest(dense, K).withColumn("model", F.lit("linear_regression")).withColumns(kinds)
    pairs = pairs.unionByName(forecast.walk_forward(dense, K, "y").withColumns(kinds))
    scores = forecast.scored(pairs.groupBy("k", "model").agg(F.avg("y").alias("mean_y"), *[c.alias(n) for n, c in forecast.errors().items()]))
    return rounded(forecast.ranked(scores.select("k", "model", "mae", "wape", "composite"), K), "mae", "wape", "composite")


@query(
    f"""WITH {GAPPED} SELECT k, CASE WHEN count(*) < 15 THEN 'only ' || count(*) || ' months of 15' ELSE 'no sales' END AS reason FROM gapped GROUP BY k HAVING count(*) < 15 OR sum(coalesce(y, 0.0)) <= 0"""
)
def regression_unfit(spark, d):
    """The series that are too short for a regression, as rows with the reason."""
    return regression.unfit(monthly_parts(spark, d), K)


#: Trees and their weight in the registered queries: fewer and larger steps than the library's default.
TREES, RATE = 6, 0.3


def boosted(spark, d):
    """The frame of all series and the model that is fitted to it."""
    rows = regression.frame(monthly_parts(spark, d), K)
    return rows, boosting.fit(rows, K, TREES, RATE)


@query()
def boosted_forecast(spark, d):
    rows, model = boosted(spark, d)
    return rounded(boosting.forecast(model, rows, K, 6), "yhat")


@query()
def boosted_importance(spark, d):
    """The features that the trees gain most by, with their share of the mean gains in percent."""
    _, model = boosted(spark, d)
    rows = spark.createDataFrame([("all", *x) for x in boosting.importances(model)], "k string, feature string, importance double, splits int")
    return rounded(forecast.importances(rows, K), "importance", "normalized_importance").drop("k")


def part_prices(spark, d):
    """Monthly quantities and prices of every offer and region, decomposed."""
    rows = marts.sales(spark, d).groupBy(F.concat_ws("|", "offer_code", "region_label").alias("k"), F.trunc("sale_date", "MM").alias("date")).agg(F.sum("qty").alias("y"), F.avg("price").alias("price"))
    return anomaly.decomposed(rows, K, "y")


@query()
def forest_anomalies(spark, d):
    found = forest.isolated(part_prices(spark, d), K, "y", "price", "residual")
    return rounded(found, "forest_score", "z", "expected", "variance_pct").select("k", "date", "y", "forest_score", "z", "expected", "variance_pct", "anomaly_type", "severity")


def _pipeline_sql() -> str:
    return f"""{GAPPED}, p AS (SELECT k, date, coalesce(y, 0.0)::DOUBLE AS y, row_number() OVER (PARTITION BY k ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM gapped),
l AS (SELECT k, n, max(date) AS last, arg_max(y, date) AS ly FROM p GROUP BY k, n),
ah AS (SELECT l.k, g.s AS step, CAST(last + to_months(g.s::INT) AS DATE) AS date, CASE WHEN l.n >= 12 THEN 'seasonal_naive' ELSE 'naive_last' END AS model, coalesce(p.y, ly) AS yhat FROM l CROSS JOIN generate_series(1, 6) AS g(s) LEFT JOIN p ON p.k = l.k AND l.n >= 12 AND p.i = l.n - 13 + g.s WHERE l.n >= 2),
each_ AS (SELECT *, 1.28::DOUBLE * greatest(1.0::DOUBLE, stddev_pop(yhat) OVER (PARTITION BY k)) AS w FROM ah),
total AS (SELECT date, sum(yhat) AS yhat FROM ah GROUP BY date), all_ AS (SELECT *, 1.28::DOUBLE * greatest(1.0::DOUBLE, stddev_pop(yhat) OVER ()) AS w, row_number() OVER (ORDER BY date) AS step FROM total)"""


@query(
    f"""WITH {_pipeline_sql()}
SELECT 'per_family' AS scope, k, step, date, {r("yhat")} AS yhat, {r("greatest(0.0, yhat - w)")} AS lower, {r("yhat + w")} AS upper, model, CASE WHEN model <> 'seasonal_naive' THEN 'seasonal_naive' END AS downgraded_from, NULL AS reason FROM each_
UNION ALL SELECT 'global', NULL, step, date, {r("yhat")}, {r("greatest(0.0, yhat - w)")}, {r("yhat + w")}, 'seasonal_naive', NULL, NULL FROM all_
UNION ALL SELECT 'failed', k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'only ' || n || ' months of 2' FROM l WHERE n < 2"""
)
def stock_pipeline(spark, d):
    """Forecasts of all series, of their sum, and the series without one."""
    return rounded(stock_forecast.pipeline(monthly_parts(spark, d), K, "y", 6), "yhat", "lower", "upper")


@query(
    f"""WITH {_pipeline_sql()}, c AS (SELECT count(*) FILTER (n >= 2) AS n_forecast, count(*) FILTER (n < 2) AS n_failed FROM l),
h AS (SELECT date, sum(y) AS y FROM p WHERE n >= 2 GROUP BY date), e AS (SELECT (SELECT arg_max(yhat, date) FROM total) AS ahead, (SELECT arg_max(y, date) FROM h) AS last)
SELECT n_forecast, n_failed, n_failed > 0 AS partial_results, {r("coalesce((ahead - last) * 100 / greatest(1.0::DOUBLE, last), 0.0)")} AS change_pct, CASE WHEN coalesce(ahead - last, 0) >= 0 THEN 'hausse' ELSE 'baisse' END AS trend FROM c, e"""
)
def stock_pipeline_summary(spark, d):
    rows = monthly_parts(spark, d)
    return rounded(stock_forecast.summary(stock_forecast.pipeline(rows, K, "y", 6), rows, K, "y"), "change_pct")
