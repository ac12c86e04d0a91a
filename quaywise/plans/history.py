"""Registered query of a stock's earlier months, with the SQL of the same steps."""

from __future__ import annotations

from quaywise.operators import replenishment
from quaywise.plans.queries import GRAIN, STOCK, query, stock


def _u(what: str) -> str:
    return f"(('0x' || substr(md5('{what}|' || strftime(month, '%Y-%m') || '|' || product_category || '|' || region_label), 1, 8))::BIGINT::DOUBLE / 4294967296)"


def _noisy(x: str, what: str) -> str:
    return f"floor({x} * (1 + {replenishment.NOISE[what]}::DOUBLE * (2 * {_u(what)} - 1)) + 0.5)"


@query(
    f"""WITH RECURSIVE {STOCK}, rows AS (SELECT product_category, region_label, month, coalesce(sold, 0)::DOUBLE AS y, coalesce(activations, 0)::DOUBLE AS a, on_hand::DOUBLE AS s, (year(month) * 12 + month(month))::DOUBLE AS m FROM stock),
sums AS (SELECT product_category, region_label, min(month) AS first, min(m) AS m0, count(*)::DOUBLE AS n, sum(y) AS y, sum(a) AS a, sum(m) AS m, sum(m * m) AS mm, sum(m * y) AS my, arg_min(s, month) AS first_stock FROM rows GROUP BY 1, 2),
season AS (SELECT product_category, region_label, month(month) AS moy, sum(y) / count(*)::DOUBLE AS usual FROM rows GROUP BY 1, 2, 3),
trend AS (SELECT *, y / n AS mean, CASE WHEN n * mm - m * m > 0 THEN (n * my - m * y) / (n * mm - m * m) ELSE 0::DOUBLE END AS slope FROM sums),
line AS (SELECT *, mean - slope * (m / n - m0) AS intercept, CASE WHEN y > 0 THEN a / y ELSE 0.82::DOUBLE END AS ratio FROM trend),
months AS (SELECT product_category, region_label, i, CAST(first - to_months(i::INT) AS DATE) AS month, mean, slope, intercept, ratio FROM line, generate_series(1, 24) AS g(i)),
steps AS (SELECT l.*, greatest(1::DOUBLE, (intercept - slope * i) * coalesce(CASE WHEN mean > 0 THEN usual / mean END, 1::DOUBLE)) AS demand FROM months l LEFT JOIN season s ON l.product_category = s.product_category AND l.region_label = s.region_label AND month(l.month) = moy),
told AS (SELECT *, greatest(1::DOUBLE, {_noisy("demand", "sold")}) AS sold, floor(demand * (3.5::DOUBLE + 1.5::DOUBLE * {_u("fill")}) + 0.5) AS fill FROM steps),
walk AS (
 SELECT product_category, region_label, 25::BIGINT AS i, greatest(10::DOUBLE, first_stock * greatest(0.3::DOUBLE, 1 - slope * 24 / greatest(intercept, 1::DOUBLE))) AS on_hand, 0::DOUBLE AS received, 0::DOUBLE AS opening FROM line
 UNION ALL
 SELECT t.product_category, t.region_label, t.i, greatest(0::DOUBLE, w.on_hand + CASE WHEN w.on_hand < 2 * demand THEN fill ELSE 0 END - sold), CASE WHEN w.on_hand < 2 * demand THEN fill ELSE 0 END, w.on_hand + CASE WHEN w.on_hand < 2 * demand THEN fill ELSE 0 END
 FROM walk w JOIN told t ON w.product_category = t.product_category AND w.region_label = t.region_label AND t.i = w.i - 1)
SELECT product_category, region_label, month, sold, {_noisy("sold * ratio", "activations")} AS activations, {_noisy("sold * 0.12::DOUBLE", "reserved")} AS reserved, received, on_hand, {_noisy("on_hand * 1.05::DOUBLE", "counted")} AS counted, {_noisy("opening", "opening")} AS opening
FROM told JOIN walk USING (product_category, region_label, i)"""
)
def stock_backcast(spark, d):
    """Two years before each category's and place's first month of stock."""
    return replenishment.backcast(stock(spark, d), GRAIN)
