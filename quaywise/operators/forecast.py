"""Forecasts per series, their errors, backtests and choices between models.

The plain models are windows and joins. Models that have to be fitted run in numpy, a series and model (and fold) a group:
a series is a few hundred periods at most (months or days of one member), so a group is bounded by the calendar, not by
the sales, and there are as many as there are members.
"""

from __future__ import annotations

from importlib.util import find_spec

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.functions.scalar import chain, percent_in, ratio
from quaywise.operators.series import latest, over

# Models in order of preference, months of history that models need, horizons at most, and libraries of models.
PREFERENCE = ("patchtst", "autogluon", "seasonal_naive", "lstm", "prophet", "naive_last")
LEAST_HISTORY = {"lstm": 8, "patchtst": 8, "autogluon": 8, "prophet": 8, "sarima": 8}
HORIZONS = {"day": 6, "month": 12}
LIBRARIES = {"patchtst": "neuralforecast", "autogluon": "autogluon", "chronos": "chronos"}
BASELINES = ("naive_last", "seasonal_naive")


def horizon_of(asked: int, unit: str) -> int:
    return min(asked, HORIZONS[unit])


def holdout_size(n: int, horizon: int, unit: str) -> int:
    """Periods to hold out of n: as many as are to be forecast, but 3 months or 7 days at least, and one to learn from stays."""
    if n <= 2:
        return 1
    return max(1, min(max(3 if unit == "month" else 7, min(horizon, HORIZONS[unit])), n - 1))


def available() -> list[str]:
    """The models of other libraries that could run here."""
    return [model for model, library in LIBRARIES.items() if find_spec(library)]


def service_asked(asked: str | None, detected: str | None, known: DataFrame) -> str | None:
    """The service to forecast: the one asked for, else the one that an upload was detected to be of, else None for all.

    known: service_code. An unknown one that was asked for is an error.
    """
    has = lambda code: not known.where(F.upper(F.trim("service_code")) == code).limit(1).isEmpty()
    code = (asked or "").strip().upper()
    if code:
        if code not in ("ALL", "*") and not has(code):
            raise ValueError(f"there are no sales of the service {code}")
        return None if code in ("ALL", "*") else code
    code = (detected or "").strip().upper()
    return code if code and has(code) else None


def effective_model(model: str, n: Column, season: int = 12) -> Column:
    """The model, or a naive one where the history (n periods) is too short for it."""
    return F.when(n >= LEAST_HISTORY.get(model, 1), model).when(n >= season, "seasonal_naive").otherwise("naive_last")


def numbered(series: DataFrame, keys: list[str]) -> DataFrame:
    """series with i (from 0) and n, the length."""
    return series.withColumns({"i": F.row_number().over(over(keys)) - 1, "n": F.count("*").over(W.partitionBy(*keys))})


def future(keys: list[str], last: DataFrame, steps: int, unit: str) -> DataFrame:
    """(keys, step, date) after each series' last date."""
    rows = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    date = F.add_months(F.trunc("last_date", "MM"), F.col("step")) if unit == "month" else F.date_add("last_date", F.col("step"))
    return rows.withColumn("date", date)


def naive_last(series: DataFrame, keys: list[str], value: str, steps: int, unit: str = "month") -> DataFrame:
    last = series.groupBy(*keys).agg(F.max("date").alias("last_date"), F.max_by(value, "date").alias("yhat"))
    return future(keys, last, steps, unit).select(*keys, "step", "date", "yhat", F.lit("naive_last").alias("model"))


def seasonal_naive(series: DataFrame, keys: list[str], value: str, steps: int, season: int = 12, unit: str = "month") -> DataFrame:
    """The last season again and again; series shorter than a season repeat their last value."""
    rows = numbered(series, keys)
    last = rows.groupBy(*keys).agg(F.max("date").alias("last_date"), F.max("n").alias("n"), F.max_by(value, "date").alias("last_value"))
    ahead = future(keys, last, steps, unit).withColumn("i", F.when(F.col("n") >= season, F.col("n") - season + (F.col("step") - 1) % season))
    return ahead.join(rows.select(*keys, "i", F.col(value).alias("v")), [*keys, "i"], "left").select(*keys, "step", "date", F.coalesce("v", "last_value").alias("yhat"), F.lit("seasonal_naive").alias("model"))


def sigma(series: DataFrame, keys: list[str], value: str, season: int = 12) -> DataFrame:
    """One-step deviations (population, at least 1) of the differences and of the seasonal ones."""
    rows = series.withColumns({"_d": F.col(value) - F.lag(value).over(over(keys)), "_s": F.col(value) - F.lag(value, season).over(over(keys))})
    least = lambda c: F.greatest(F.coalesce(F.stddev_pop(c), F.lit(1.0)), F.lit(1.0))
    return rows.groupBy(*keys).agg(least("_d").alias("sigma"), F.greatest(F.coalesce(F.stddev_pop("_s"), F.stddev_pop("_d"), F.lit(1.0)), F.lit(1.0)).alias("sigma_seasonal"))


def widened(forecast: DataFrame, z: float = 1.28) -> DataFrame:
    """The band of a forecast (step, yhat, sigma) widens with the root of the step; its lower edge isn't below 0."""
    wide = F.lit(z) * F.col("sigma") * F.sqrt(F.col("step").cast("double"))
    return forecast.withColumns({"lower": F.greatest(F.lit(0.0), F.col("yhat") - wide), "upper": F.col("yhat") + wide})


def banded(forecast: DataFrame, sigmas: DataFrame, keys: list[str], z: float = 1.28) -> DataFrame:
    return widened(forecast.join(sigmas, keys), z)


def ensemble(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    return forecasts.groupBy(*keys, "step").agg(F.avg("yhat").alias("yhat"), F.stddev_pop("yhat").alias("spread"), F.count("*").alias("members"))


def weighted_ensemble(forecasts: DataFrame, errors: DataFrame, keys: list[str], best: int = 3) -> DataFrame:
    """The best models by score but for the naive ones, weighted by its inverse."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("score", "model"))
    chosen = errors.where(~F.col("model").isin(*BASELINES)).withColumn("_r", rank).where(F.col("_r") <= best).select(*keys, "model", (1 / F.greatest(F.col("score"), F.lit(1e-6))).alias("w"))
    return forecasts.join(chosen, [*keys, "model"]).groupBy(*keys, "step").agg((F.sum(F.col("w") * F.col("yhat")) / F.sum("w")).alias("yhat"), F.count("*").alias("members"))


def errors(y: str = "y", yhat: str = "yhat") -> dict[str, Column]:
    """Aggregates over pairs of an actual and a predicted value."""
    a, f = F.col(y), F.col(yhat)
    base = F.when(a == 0, 1.0).otherwise(a)
    both = F.abs(a) + F.abs(f)
    return {
        "mae": F.avg(F.abs(f - a)),
        "rmse": F.sqrt(F.avg((f - a) * (f - a))),
        "mape": F.avg(F.abs(base - f) / F.abs(base)) * 100,
        "smape": F.avg(2 * F.abs(f - a) / F.when(both == 0, 1.0).otherwise(both)) * 100,
        "wape": F.coalesce(ratio(F.sum(F.abs(a - f)) * 100, F.sum(F.abs(a))), F.lit(0.0)),
        "mpe": F.avg((f - base) / base) * 100,
        "bias": F.avg(f - a),
        "n": F.count("*"),
    }


def measured(pairs: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    return pairs.groupBy(*keys).agg(*[c.alias(n) for n, c in errors(y, yhat).items()])


def scored(metrics: DataFrame) -> DataFrame:
    """The composite score (MAPE and half the bias share of `mean_y`) and the weighted one."""
    capped = lambda c: F.least(F.lit(100.0), F.col(c)) / 100
    bias = F.abs(F.col("bias")) * 100 / F.greatest(F.lit(1.0), F.col("mean_y"))
    return metrics.withColumns({"bias_pct": bias, "composite": F.col("mape") + 0.5 * bias, "weighted": 0.40 * capped("wape") + 0.25 * capped("rmse") + 0.20 * capped("mae") + 0.15 * capped("smape")})


def walk_forward(series: DataFrame, keys: list[str], value: str, season: int = 12, folds: int = 3) -> DataFrame:
    """One-origin-a-fold predictions of the naive models: (keys, fold, model, i, y, yhat).

    The last folds * test rows are dealt to the folds, test being n // (folds + 1); training rows are those before.
    """
    rows = numbered(series, keys).withColumn("test", F.floor(F.col("n") / (folds + 1)))
    rows = rows.withColumn("fold", F.floor((F.col("i") - (F.col("n") - folds * F.col("test"))) / F.nullif(F.col("test"), F.lit(0))) + 1)
    rows = rows.withColumn("origin", F.col("n") - (folds - F.col("fold") + 1) * F.col("test"))
    tests = rows.where((F.col("fold") >= 1) & (F.col("origin") >= 1))
    past = rows.select(*keys, F.col("i").alias("_i"), F.col(value).alias("_v"))
    ref = F.array(
        F.struct(F.lit("naive_last").alias("model"), (F.col("origin") - 1).cast("long").alias("_i")),
        F.struct(F.lit("seasonal_naive").alias("model"), F.when(F.col("origin") >= season, F.col("origin") - season + (F.col("i") - F.col("origin")) % season).otherwise(F.col("origin") - 1).cast("long").alias("_i")),
    )
    asked = tests.select(*keys, "fold", "i", F.col(value).alias("y"), F.inline(ref))
    return asked.join(past, [*keys, "_i"]).select(*keys, "fold", "model", "i", "y", F.col("_v").alias("yhat"))


def rolling_origin(series: DataFrame, keys: list[str], value: str, horizon: int = 3, least: int = 12, season: int = 12) -> DataFrame:
    """Predictions of the naive models from every origin that has `least` periods before it: (keys, origin, model, i, y, yhat).

    An origin is tested on up to three periods. Each row finds the origins that test it, so nothing is paired beyond that.
    """
    test = max(1, min(horizon, 3))
    rows = numbered(series, keys)
    past = rows.select(*keys, F.col("i").alias("_i"), F.col(value).alias("_v"))
    low, high = F.greatest(F.lit(least), F.col("i") - test + 1), F.least(F.col("i"), F.col("n") - test)
    asked = rows.where(high >= low).select(*keys, "i", F.col(value).alias("y"), F.explode(F.sequence(low, high)).alias("origin"))
    back = F.when(F.col("origin") >= season, F.col("origin") - season + F.col("i") - F.col("origin")).otherwise(F.col("origin") - 1)
    models = F.array(F.struct(F.lit("naive_last").alias("model"), (F.col("origin") - 1).cast("long").alias("_i")), F.struct(F.lit("seasonal_naive").alias("model"), back.cast("long").alias("_i")))
    return asked.select(*keys, "origin", "i", "y", F.inline(models)).join(past, [*keys, "_i"]).select(*keys, "origin", "model", "i", "y", F.col("_v").alias("yhat"))


def single_holdout(series: DataFrame, keys: list[str], value: str, horizon: int, season: int = 12) -> DataFrame:
    """One test on the last `horizon` periods: the naive models repeat the last value before, or the one a season before it."""
    rows = numbered(series, keys).withColumn("test", F.greatest(F.lit(1), F.least(F.lit(horizon), F.col("n") - 1)))
    past = rows.select(*keys, F.col("i").alias("_i"), F.col(value).alias("_v"))
    train = F.col("n") - F.col("test")
    models = F.array(F.struct(F.lit("naive_last").alias("model"), (train - 1).cast("long").alias("_i")), F.struct(F.lit("seasonal_naive").alias("model"), F.when(train >= season, train - season).otherwise(train - 1).cast("long").alias("_i")))
    asked = rows.where(F.col("i") >= train).select(*keys, "i", F.col(value).alias("y"), F.inline(models))
    return asked.join(past, [*keys, "_i"]).select(*keys, "model", "i", "y", F.col("_v").alias("yhat"))


def walk_forward_real(series: DataFrame, keys: list[str], value: str, real: str, horizon: int = 6, season: int = 12) -> DataFrame:
    """Walk-forward predictions over folds of `horizon` periods, three at most: (keys, fold, model, i, y, yhat).

    Only periods with real records (column `real` above 0) are tested, all of a fold that has none; folds whose actual
    values sum to nothing are left out, and so are series too short for two folds.
    """
    rows = numbered(series, keys).withColumn("test", F.greatest(F.lit(1), F.least(F.lit(horizon), F.col("n") - 1)))
    rows = rows.withColumn("folds", F.least(F.lit(3), F.floor((F.col("n") - 1) / F.col("test"))).cast("int")).where("folds >= 2")
    past = rows.select(*keys, F.col("i").alias("_i"), F.col(value).alias("_v"))
    fold = (F.floor((F.col("i") - (F.col("n") - F.col("folds") * F.col("test"))) / F.col("test")) + 1).cast("int")
    tests = rows.withColumn("fold", fold).where("fold >= 1").withColumn("origin", (F.col("n") - (F.col("folds") - F.col("fold") + 1) * F.col("test")).cast("long"))
    per = W.partitionBy(*keys, "fold")
    tests = tests.withColumns({"_some": F.max(F.col(real) > 0).over(per)}).where((F.col(real) > 0) | ~F.col("_some"))
    tests = tests.withColumn("_sum", F.sum(F.abs(F.col(value))).over(per)).where(F.col("_sum") >= 1e-9)
    back = F.when(F.col("origin") >= season, F.col("origin") - season + (F.col("i") - F.col("origin")) % season).otherwise(F.col("origin") - 1)
    models = F.array(F.struct(F.lit("naive_last").alias("model"), (F.col("origin") - 1).cast("long").alias("_i")), F.struct(F.lit("seasonal_naive").alias("model"), back.cast("long").alias("_i")))
    asked = tests.select(*keys, "fold", "i", F.col(value).alias("y"), F.inline(models))
    return asked.join(past, [*keys, "_i"]).select(*keys, "fold", "model", "i", "y", F.col("_v").alias("yhat"))


def ranked(scores: DataFrame, keys: list[str], asked: tuple[str, ...] = ()) -> DataFrame:
    """Models by composite score, the best first; models that were asked for and have no score come without a rank."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("composite", "model"))
    out = scores.withColumn("rank", rank)
    if not asked:
        return out
    every = scores.select(*keys).distinct().select(*keys, F.explode(F.array(*map(F.lit, asked))).alias("model"))
    return out.join(every, [*keys, "model"], "full").withColumn("status", F.when(F.col("rank").isNull(), "failed").otherwise("completed"))


def backtest_report(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each model the errors of every fold with its actual and predicted values in order, and the errors over all folds."""
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c])
    folds = pairs.groupBy(*keys, "model", "fold").agg(ordered("y").alias("actuals"), ordered("yhat").alias("predicted"), *[c.alias(n) for n, c in errors().items()])
    per = folds.groupBy(*keys, "model").agg(F.array_sort(F.collect_list(F.struct("fold", "actuals", "predicted", "mae", "rmse", "mape", "smape", "bias"))).alias("folds"))
    return per.join(measured(pairs, [*keys, "model"]), [*keys, "model"])


def importances(rows: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The k most important features (feature, importance) of each key, of those above 0, with their share of all in percent."""
    total = F.sum("importance").over(W.partitionBy(*keys))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("importance"), "feature"))
    return rows.where(F.col("importance") > 0).withColumns({"normalized_importance": F.col("importance") * 100 / total, "rank": rank}).where(F.col("rank") <= k)


def what_if(forecast: DataFrame, text: Column, value: str = "yhat") -> DataFrame:
    """The forecast moved by the percentage in a text; without one a promotion means 20 % more, a rupture 25 % less."""
    t = F.lower(text)
    told = F.coalesce(percent_in(t), F.lit(0.0))
    shift = F.when(told != 0, told).when(F.contains(t, F.lit("promo")), 0.20).when(F.contains(t, F.lit("rupture")) | F.contains(t, F.lit("stockout")), -0.25).otherwise(0.0)
    return forecast.withColumn("shift_pct", shift * 100).withColumn("scenario", F.col(value) * (1 + shift))


def is_flat(forecast: DataFrame, keys: list[str], value: str = "yhat") -> DataFrame:
    """Whether a forecast hardly moves: within 3 % of its mean (or 1), or on two values at most (to two digits)."""
    span = F.max(value) - F.min(value)
    flat = span <= F.greatest(F.lit(1.0), F.abs(F.avg(value)) * 0.03)
    return forecast.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), flat.alias("flat"), (flat | (F.countDistinct(F.round(value, 2)) <= 2)).alias("stable"))


def steady_band(forecast: DataFrame, keys: list[str], z: float = 1.28) -> DataFrame:
    """A band of one width for a stock forecast, from the deviation of the forecast values (1 at least)."""
    wide = F.lit(z) * F.greatest(F.lit(1.0), F.stddev_pop("yhat").over(W.partitionBy(*keys)))
    return forecast.withColumns({"lower": F.greatest(F.lit(0.0), F.col("yhat") - wide), "upper": F.col("yhat") + wide})


def ensemble_band(forecast: DataFrame, sigmas: DataFrame, keys: list[str], z: float = 1.28) -> DataFrame:
    """The band of an ensemble: the spread of its members at the step, and what grows with the root of the step."""
    wide = F.lit(z) * (F.col("spread") + F.col("sigma") * F.sqrt(F.col("step").cast("double")))
    return forecast.join(sigmas, keys).withColumns({"lower": F.greatest(F.lit(0.0), F.col("yhat") - wide), "upper": F.col("yhat") + wide})


def recency_weighted(by_fold: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Mean over folds with weights rising evenly from 0.5 to 1.5; best and worst fold."""
    w = W.partitionBy(*keys)
    k = F.count("*").over(w)
    rows = by_fold.withColumn("w", F.when(k == 1, 1.0).otherwise(0.5 + (F.row_number().over(w.orderBy("fold")) - 1) / F.greatest(k - 1, F.lit(1))))
    return rows.groupBy(*keys).agg((F.sum(F.col("w") * F.col(score)) / F.sum("w")).alias("score"), F.min_by("fold", F.struct(score, "fold")).alias("best_fold"), F.max_by("fold", F.struct(score, "fold")).alias("worst_fold"), F.count("*").alias("folds"))


def near_tie_choice(scores: DataFrame, keys: list[str], within: float = 0.10) -> DataFrame:
    """Of the models within 10 % of the best score the one that comes first in the order of preference."""
    rank = chain([(F.col("model") == m, i) for i, m in enumerate(PREFERENCE)], len(PREFERENCE))
    rows = scores.withColumn("_b", F.min("score").over(W.partitionBy(*keys))).where(F.col("score") <= F.col("_b") * (1 + within))
    return latest(rows.withColumn("_p", rank), keys, F.col("_p"), F.col("score"), F.col("model")).select(*keys, "model", "score")


def gap_to_baseline(scores: DataFrame, keys: list[str], model: str, baseline: str) -> DataFrame:
    """How much better the model is than the baseline in percent, and the strength of the signal."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("score")))
    rows = scores.groupBy(*keys).agg(pick(model).alias("target"), pick(baseline).alias("base"))
    gap = ratio((F.col("base") - F.col("target")) * 100, F.col("base"))
    return rows.withColumn("gap_pct", gap).withColumn("grade", chain([(F.col("gap_pct") < 2, "WEAK"), (F.col("gap_pct") < 5, "MODERATE"), (F.col("gap_pct") < 10, "GOOD"), (F.col("gap_pct") >= 10, "STRONG")]))


def linear_trend(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    return numbered(series, keys).groupBy(*keys).agg(F.regr_slope(value, "i").alias("slope"), F.regr_intercept(value, "i").alias("intercept"), F.count("*").alias("n"))


def seasonal_indices(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of each month of the year over the mean of these means."""
    by = series.groupBy(*keys, F.month("date").alias("month")).agg(F.avg(value).alias("m"))
    return by.select(*keys, "month", ratio(F.col("m"), F.avg("m").over(W.partitionBy(*keys)), 1.0).alias("seasonal_index"))


def shares(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.sum(value).alias("total")).withColumn("share", ratio(F.col("total"), F.sum("total").over(W.partitionBy()), 0.0))


def change(forecast: DataFrame, series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Last forecast against last actual value: percent and direction."""
    a = series.groupBy(*keys).agg(F.max_by(value, "date").alias("last_actual"))
    f = forecast.groupBy(*keys).agg(F.max_by("yhat", "step").alias("last_forecast"))
    rows = a.join(f, keys).withColumn("change_pct", (F.col("last_forecast") - F.col("last_actual")) * 100 / F.greatest(F.lit(1.0), F.abs(F.col("last_actual"))))
    return rows.withColumn("trend", F.when(F.col("change_pct") >= 0, "hausse").otherwise("baisse"))


def holt_fit(y: np.ndarray) -> tuple[float, float, float]:
    """Of additive-trend exponential smoothing with the pair of weights that has the least squared one-step error: that error, last level and trend."""
    best = (np.inf, 0.0, 0.0)
    for a in np.linspace(0.1, 0.9, 9):
        for b in np.linspace(0.05, 0.95, 7):
            level, trend, error = y[0], y[1] - y[0], 0.0
            for v in y[1:]:
                error += (v - level - trend) ** 2
                was, level = level, a * v + (1 - a) * (level + trend)
                trend = b * (level - was) + (1 - b) * trend
            if error < best[0]:
                best = error, level, trend
    return best


def holt(y: np.ndarray, steps: int) -> np.ndarray:
    """Additive-trend exponential smoothing, not below 0; of fewer than three values the last one."""
    if len(y) < 3:
        return np.repeat(y[-1:], steps)
    _, level, trend = holt_fit(y)
    return np.maximum(level + trend * np.arange(1, steps + 1), 0)


def recursive_regression(y: np.ndarray, first_month: int, steps: int) -> np.ndarray:
    """Ridge regression on trend, season and lags 1, 2, 3 and 12, fitted anew for each step to what it has predicted so far, not below 0."""
    y, n = list(map(float, y)), len(y)
    lag = [k for k in (1, 2, 3, 12) if k < n / 2]
    row = lambda i: [1.0, i, np.sin(2 * np.pi * (first_month + i) / 12), np.cos(2 * np.pi * (first_month + i) / 12), *(y[i - k] for k in lag)]
    start = max(lag, default=0)
    x = [row(i) for i in range(start, n)]
    for i in range(n, n + steps):
        a = np.array(x)
        w = np.linalg.solve(a.T @ a + 1e-3 * np.eye(a.shape[1]), a.T @ np.array(y[start:]))
        x.append(row(i))
        y.append(max(0.0, float(np.dot(x[-1], w))))
    return np.array(y[n:])


def changepoint_trend(y: np.ndarray, first_month: int, steps: int) -> np.ndarray:
    """Piecewise-linear trend (bends in the first four fifths, shrunk) and a yearly Fourier series, by ridge regression."""
    n = len(y)
    t = np.arange(n + steps) / max(n - 1, 1)
    bends = np.linspace(0, 0.8, min(8, max(n // 4, 1)) + 2)[1:-1]
    season = 2 * np.pi * (first_month + np.arange(n + steps))[:, None] * np.arange(1, 4)[None, :] / 12
    order = 3 if n >= 24 else 0
    x = np.column_stack([np.ones(n + steps), t, *(np.maximum(t - b, 0) for b in bends), np.sin(season[:, :order]), np.cos(season[:, :order])])
    shrink = np.diag([1e-6, 1e-3] + [1.0] * len(bends) + [1e-2] * (2 * order))
    w = np.linalg.solve(x[:n].T @ x[:n] + shrink, x[:n].T @ y)
    return np.maximum(x[n:] @ w, 0)


def seasonal_arima(y: np.ndarray, steps: int, season: int = 12) -> np.ndarray:
    """(1,1,1)(1,1,1) by conditional least squares: each of the four weights is searched in turn, three times round.

    Series of fewer than two seasons get the exponential smoothing.
    """
    if len(y) < 2 * season:
        return holt(y, steps)
    w = np.diff(y)[season:] - np.diff(y)[:-season]

    def residuals(a: float, b: float, c: float, d: float) -> list[float]:
        e: list[float] = []
        at = lambda v, i: v[i] if i >= 0 else 0.0
        for i in range(len(w)):
            past = a * at(w, i - 1) + c * at(w, i - season) - a * c * at(w, i - season - 1)
            e.append(w[i] - past - b * at(e, i - 1) - d * at(e, i - season) - b * d * at(e, i - season - 1))
        return e

    p = [0.0] * 4
    for _ in range(3):
        for k in range(4):
            p[k] = min(np.linspace(-0.9, 0.9, 13), key=lambda v: sum(x * x for x in residuals(*p[:k], v, *p[k + 1 :])))
    a, b, c, d = p
    e, w, out = residuals(*p), list(w), list(map(float, y))
    for _ in range(steps):
        i = len(w)
        at = lambda v, j: v[j] if 0 <= j < len(v) else 0.0
        w.append(a * at(w, i - 1) + c * at(w, i - season) - a * c * at(w, i - season - 1) + b * at(e, i - 1) + d * at(e, i - season) + b * d * at(e, i - season - 1))
        e.append(0.0)
        out.append(w[-1] + out[-1] + out[-season] - out[-season - 1])
    return np.maximum(np.array(out[len(y) :]), 0)


def boosted_stumps(y: np.ndarray, first_month: int, steps: int, rounds: int = 150, rate: float = 0.1) -> np.ndarray:
    """Gradient boosting of two-leaf trees over lags, month and trend, fed its own predictions."""
    y, n = list(map(float, y)), len(y)
    lag = [k for k in (1, 2, 3, 12) if k < n / 2]
    start = max(lag, default=0)
    row = lambda i: [i, (first_month + i) % 12, *(y[i - k] for k in lag)]
    x, target = np.array([row(i) for i in range(start, n)], float), np.array(y[start:])
    base, trees = target.mean(), []
    rest = target - base
    splits = [(f, v, x[:, f] <= v) for f in range(x.shape[1]) for v in np.unique(np.quantile(x[:, f], np.linspace(0.1, 0.9, 9)))]
    splits = [(f, v, left, ~left, left.sum()) for f, v, left in splits if left.any() and not left.all()]
    for _ in range(rounds):
        best = None
        for f, v, left, right, size in splits:
            lo, hi = rest[left].mean(), rest[right].mean()
            gain = size * lo * lo + (len(rest) - size) * hi * hi
            if best is None or gain > best[0]:
                best = (gain, f, v, rate * lo, rate * hi)
        if best is None:
            break
        trees.append(best[1:])
        rest = rest - np.where(x[:, best[1]] <= best[2], best[3], best[4])
    for i in range(n, n + steps):
        now = row(i)
        y.append(max(0.0, base + sum(lo if now[f] <= v else hi for f, v, lo, hi in trees)))
    return np.array(y[n:])


FITTED = {
    "holt": lambda y, m, h: holt(y, h),
    "linear_regression": recursive_regression,
    "changepoint_trend": changepoint_trend,
    "seasonal_arima": lambda y, m, h: seasonal_arima(y, h),
    "boosted_stumps": boosted_stumps,
}
#: Models whose deviation is that of a holdout.
HELD_OUT = ("linear_regression", "boosted_stumps")


def one_step_sigma(model: str, y: np.ndarray, first_month: int) -> float:
    """A model's one-step deviation, 1 at least: of its fit (smoothing), of a holdout of up to three values (regression, boosting), else of the differences."""
    n, found = len(y), None
    if model == "holt" and n >= 3:
        found = np.sqrt(holt_fit(y)[0] / (n - 2))
    elif model in HELD_OUT and n >= 5:
        k = min(3, n // 5)
        found = np.sqrt(np.mean((y[-k:] - FITTED[model](y[:-k], first_month, k)) ** 2))
    elif n >= 2:
        found = np.std(np.diff(y))
    return 1.0 if found is None else max(1.0, float(found))


def _each(series: DataFrame, keys: list[str], value: str, models: tuple[str, ...], more: Column | None = None) -> DataFrame:
    """Every series once for each model (and each of `more`), which are part of its group, so that Spark spreads the fits."""
    rows = series.select(*keys, "date", F.col(value).cast("double").alias("y")).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return rows if more is None else rows.withColumn("fold", F.explode(more))


def fitted(series: DataFrame, keys: list[str], value: str, steps: int, models: tuple[str, ...] = tuple(FITTED), sigmas: bool = False) -> DataFrame:
    """Forecasts of the models that have to be fitted, a series and model a group: (keys, model, step, yhat, sigma); sigma is NaN unless asked for."""
    kinds = {f.name: f.dataType for f in series.schema.fields}
    schema = ", ".join([f"{k} {kinds[k].simpleString()}" for k in keys] + ["model string, step int, yhat double, sigma double"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        first = pdf.iloc[0]
        model, y, month = first["model"], pdf["y"].to_numpy(float), pd.Timestamp(first["date"]).month
        out = {"model": model, "step": range(1, steps + 1), "yhat": FITTED[model](y, month, steps), "sigma": one_step_sigma(model, y, month) if sigmas else np.nan}
        return pd.DataFrame({**{k: first[k] for k in keys}, **out})

    return _each(series, keys, value, models).groupBy(*keys, "model").applyInPandas(one, schema)


def backtested(series: DataFrame, keys: list[str], value: str, folds: int = 3, models: tuple[str, ...] = tuple(FITTED)) -> DataFrame:
    """Walk-forward predictions of the fitted models: (keys, fold, model, i, y, yhat), folds dealt as in walk_forward.

    A series, model and fold is a group. Models that fail on a fold (a history too short for them) have no rows there.
    """
    kinds = {f.name: f.dataType for f in series.schema.fields}
    schema = ", ".join([f"{k} {kinds[k].simpleString()}" for k in keys] + ["fold int, model string, i int, y double, yhat double"])
    none = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        first, y, n = pdf.iloc[0], pdf["y"].to_numpy(float), len(pdf)
        test, fold = n // (folds + 1), int(first["fold"])
        origin = n - (folds - fold + 1) * test
        try:
            if not test:
                return none
            yhat = FITTED[first["model"]](y[:origin], pd.Timestamp(first["date"]).month, test)
        except (ValueError, IndexError, np.linalg.LinAlgError):
            return none
        return pd.DataFrame({**{k: first[k] for k in keys}, "fold": fold, "model": first["model"], "i": range(origin, origin + test), "y": y[origin : origin + test], "yhat": yhat})

    return _each(series, keys, value, models, F.sequence(F.lit(1), F.lit(folds))).groupBy(*keys, "model", "fold").applyInPandas(one, schema)
