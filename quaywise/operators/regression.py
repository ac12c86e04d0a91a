"""Linear regression on the feature frame of every series at once: sums of products, solved as columns, forecasts as folds.

A series' frame has its trend, the month as a sine and a cosine (to 12 digits, so that months of one sine are equal), its
values 1, 2, 3 and 12 months before and the means of the 6 and 12 before; where there are fewer months before, what is
missing is the mean of those that are there. Values are taken over the series' mean, so that all features are of one size.

The normal equations are sums over pairs of features, one aggregation for all series, pre-aggregated in each task. They are
solved in column functions (Gauss-Jordan on an array of rows, a very small ridge on the diagonal). Forecasts are a fold
over the steps: the state is the series' last twelve values; each step's features come from it, and its prediction (0 at
least) joins it. To fit anew after each step would change nothing, as a prediction lies on the regression's plane.

Backtests take the fold as one more key, so all origins of all series are fitted in the same aggregation. A series of under
LEAST months, or without any sales, has no forecast; `unfit` says so, a row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.operators.forecast import numbered
from quaywise.operators.series import over

FEATURES = ("intercept", "trend_index", "month_sin", "month_cos", "sales_lag_1", "sales_lag_2", "sales_lag_3", "sales_lag_12", "sales_roll_6", "sales_roll_12")
#: Months of a series that is fitted, months before a row that is learnt from, months that are remembered, and the ridge.
LEAST, BEFORE, MEMORY, RIDGE = 15, 3, 12, 1e-6


def _features(t: Column, month: Column, lag: dict[int, Column], means: dict[int, Column]) -> list[Column]:
    angle = month.cast("double") * F.lit(2 * math.pi / 12)
    return [F.lit(1.0), t, F.round(F.sin(angle), 12), F.round(F.cos(angle), 12), *(F.coalesce(lag[n], means[12]) for n in (1, 2, 3, 12)), means[6], means[12]]


def frame(series: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """keys, date, i, n, scale, v (the value over the scale) and the array x of features of every month of dense series (date, value)."""
    rows = numbered(series.select(*keys, "date", F.col(value).cast("double").alias("y")), keys)
    rows = rows.withColumn("scale", F.avg("y").over(W.partitionBy(*keys))).where("scale > 0").withColumn("v", F.col("y") / F.col("scale"))
    back = lambda n: over(keys).rowsBetween(-n, -1)
    rows = rows.withColumns({f"_l{n}": F.lag("v", n).over(over(keys)) for n in (1, 2, 3, 12)} | {f"_m{n}": F.avg("v").over(back(n)) for n in (6, 12)})
    x = _features((F.col("i") / F.col("n")).cast("double"), F.month("date"), {n: F.col(f"_l{n}") for n in (1, 2, 3, 12)}, {n: F.col(f"_m{n}") for n in (6, 12)})
    return rows.select(*keys, "date", "i", "n", "scale", "v", F.array(*x).alias("x"))


def solved(m: Column, p: int) -> Column:
    """The solution of p equations, rows of p coefficients and the right side, by Gauss-Jordan steps without exchange of rows."""

    def step(m: Column, k: Column) -> Column:
        pivot = lambda j: F.get(F.get(m, k), j)
        row = lambda r: F.transform(r, lambda v, j: v - F.get(r, k) * pivot(j) / pivot(k))
        return F.transform(m, lambda r, i: F.when(i == k, F.transform(r, lambda v: v / pivot(k))).otherwise(row(r)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), m, step), lambda r: F.get(r, F.lit(p)))


def coefficients(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, coef (an array in the order of FEATURES), n, scale and the number of months that were learnt from, of a frame."""
    p = len(FEATURES)
    x = lambda i: F.col("x")[i]
    sums = {f"_{i}_{j}": F.sum(x(i) * x(j)) for i in range(p) for j in range(i, p)} | {f"_{i}_{p}": F.sum(x(i) * F.col("v")) for i in range(p)}
    by = rows.where((F.col("i") >= BEFORE) & (F.col("n") >= LEAST)).groupBy(*keys).agg(F.max("n").alias("n"), F.max("scale").alias("scale"), F.count("*").alias("months"), *[c.alias(n) for n, c in sums.items()])
    cell = lambda i, j: F.col(f"_{min(i, j)}_{max(i, j)}") + (F.lit(RIDGE) * F.col("months") if i == j else F.lit(0.0))
    m = F.array(*[F.array(*[cell(i, j) for j in range(p + 1)]) for i in range(p)])
    return by.select(*keys, "n", "scale", "months", m.alias("_m")).select(*keys, "n", "scale", "months", solved(F.col("_m"), p).alias("coef"))


def _dot(coef: Column, x: list[Column]) -> Column:
    out = F.get(coef, F.lit(0)) * x[0]
    for i, c in enumerate(x[1:], 1):
        out = out + F.get(coef, F.lit(i)) * c
    return out


def memory(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, scale, last (the newest MEMORY values in order) and last_date of every series of a frame."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"])
    return rows.where(F.col("i") >= F.col("n") - MEMORY).groupBy(*keys).agg(F.max("n").alias("n"), F.max("scale").alias("scale"), ordered.alias("last"), F.max("date").alias("last_date"))


def folded(steps: int, model: Callable[[list[Column]], Column]) -> Column:
    """The predictions of so many steps by a model of the features, from last (values before, the newest last), n and month (of the last date)."""
    start = F.struct(F.col("last").alias("last"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        mean = lambda n: F.aggregate(F.slice(s["last"], F.greatest(F.size(s["last"]) - n + 1, F.lit(1)), F.lit(n)), F.lit(0.0), lambda a, v: a + v) / F.least(F.size(s["last"]), F.lit(n))
        x = _features((F.col("n") + k - 1) / F.col("n"), (F.col("month") + k - 1) % 12 + 1, {n: F.get(s["last"], F.size(s["last"]) - n) for n in (1, 2, 3, 12)}, {n: mean(n) for n in (6, 12)})
        joined = lambda v: F.struct(F.slice(F.concat(s["last"], F.array(v)), F.greatest(F.size(s["last"]) + 2 - MEMORY, F.lit(1)), F.lit(MEMORY)).alias("last"), F.concat(s["out"], F.array(v)).alias("out"))
        return F.transform(F.array(F.greatest(F.lit(0.0), model(x))), joined)[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["out"])


def forecast(series: DataFrame, keys: list[str], steps: int, value: str = "y") -> DataFrame:
    """keys, step, date, yhat and sigma (deviation of the fit, population, 1 at least) for every series that can be fitted."""
    rows = frame(series, keys, value)
    coefs = coefficients(rows, keys)
    recent = memory(rows, keys).drop("n", "scale")
    missed = F.col("v") - _dot(F.col("coef"), [F.col("x")[i] for i in range(len(FEATURES))])
    fit = rows.where(F.col("i") >= BEFORE).join(coefs.select(*keys, "coef"), keys).groupBy(*keys).agg(F.greatest(F.stddev_pop(missed * F.col("scale")), F.lit(1.0)).alias("sigma"))
    out = coefs.join(recent, keys).join(fit, keys).withColumn("month", F.month("last_date")).withColumn("ahead", folded(steps, lambda x: _dot(F.col("coef"), x)))
    out = out.select(*keys, "scale", "sigma", "last_date", F.posexplode("ahead").alias("_k", "_v"))
    return out.select(*keys, (F.col("_k") + 1).alias("step"), F.add_months(F.trunc("last_date", "MM"), F.col("_k") + 1).alias("date"), (F.col("_v") * F.col("scale")).alias("yhat"), "sigma")


def unfit(series: DataFrame, keys: list[str], value: str = "y") -> DataFrame:
    """keys and the reason, for every series that has no forecast."""
    by = series.groupBy(*keys).agg(F.count("*").alias("_n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("_mean"))
    short = F.concat(F.lit("only "), F.col("_n"), F.lit(f" months of {LEAST}"))
    return by.withColumn("reason", F.when(F.col("_n") < LEAST, short).when(F.col("_mean") <= 0, "no sales")).where("reason IS NOT NULL").select(*keys, "reason")


def backtest(series: DataFrame, keys: list[str], value: str = "y", folds: int = 3) -> DataFrame:
    """Walk-forward predictions: keys, fold, i, y and yhat, the folds dealt as `forecast.walk_forward` deals them."""
    rows = numbered(series.select(*keys, "date", F.col(value).cast("double").alias("y")), keys).withColumn("test", F.floor(F.col("n") / (folds + 1)).cast("int"))
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).withColumn("origin", F.col("n") - (folds - F.col("fold") + 1) * F.col("test"))
    past = each.where(F.col("i") < F.col("origin")).select(*keys, "fold", "date", "y")
    tests = each.where((F.col("i") >= F.col("origin")) & (F.col("i") < F.col("origin") + F.col("test")))
    steps = rows.agg(F.coalesce(F.max("test"), F.lit(0))).first()[0]
    if not steps:
        return tests.select(*keys, "fold", "i", "y", F.lit(None).cast("double").alias("yhat")).limit(0)
    found = forecast(past, [*keys, "fold"], steps).select(*keys, "fold", "date", "yhat")
    return tests.join(found, [*keys, "fold", "date"]).select(*keys, "fold", "i", "y", "yhat")
