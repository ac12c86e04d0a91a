"""Stock forecasts of many series at once, with the series that have none as rows, too.

Every series (a product family, say) gives either its forecast or one row with the reason why not, so that one bad series
doesn't cost the others theirs. A series that is too short for the model asked for takes a simpler one, and says so. The
global forecast is the sum of the series' own by date, of those that have one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.operators import forecast, regression

#: What a series can be forecast with here.
MODELS = ("naive_last", "seasonal_naive", "linear_regression")
#: Months that a series needs for any forecast.
LEAST_MONTHS = 2
SCOPES = ("global", "per_family", "both")
FAILED = "failed"


def _reason(keys: list[str]) -> Column:
    """Why a series can't be forecast at all; null where it can. Columns _n and _bad are its length and its values that aren't numbers."""
    return (
        F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) > 0, F.lit("no name"))
        .when(F.col("_bad") > 0, F.concat(F.col("_bad"), F.lit(" values missing")))
        .when(F.col("_n") < LEAST_MONTHS, F.concat(F.lit("only "), F.col("_n"), F.lit(f" months of {LEAST_MONTHS}")))
    )


def _effective(model: str, n: Column, season: int) -> Column:
    """The model, or a simpler one for a series of n months that is too short for it."""
    least = {"naive_last": 0, "seasonal_naive": season, "linear_regression": max(season, regression.LEAST)}[model]
    return F.when(n >= least, model).when(n >= season, "seasonal_naive").otherwise("naive_last")


def pipeline(series: DataFrame, keys: list[str], value: str, steps: int, model: str = "seasonal_naive", scope: str = "both", season: int = 12) -> DataFrame:
    """scope (per_family, global or failed), keys, step, date, yhat, lower, upper, model, downgraded_from, reason.

    series has a row a month (keys, date, value). Failed rows come with any scope; they have keys and a reason, nulls else.
    Rows of the global forecast have null keys; their step counts the dates, and their model is the one asked for. A series
    with a null key, or a value that is null or not finite, is reported as failed; a series without rows isn't known here.
    """
    if model not in MODELS or scope not in SCOPES:
        raise ValueError(f"model is one of {', '.join(MODELS)}, scope one of {', '.join(SCOPES)}")
    v, whole = F.col("y"), W.partitionBy(*keys)
    rows = series.select(*keys, "date", F.col(value).cast("double").alias("y"))
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_bad": F.count_if(~finite).over(whole)})
    rows = rows.withColumns({"_reason": _reason(keys), "_model": _effective(model, F.col("_n"), season)})
    good = rows.where(F.col("_reason").isNull())
    failed = rows.where(F.col("_reason").isNotNull()).groupBy(*keys).agg(F.min("_reason").alias("reason"))
    of = lambda m: good.where(F.col("_model") == m).select(*keys, "date", "y")
    parts = [forecast.naive_last(of("naive_last"), keys, "y", steps), forecast.seasonal_naive(of("seasonal_naive"), keys, "y", steps, season)]
    if model == "linear_regression":
        mine = of(model)
        parts.append(regression.forecast(mine, keys, steps).withColumn("model", F.lit(model)).select(parts[0].columns))
        failed = failed.unionByName(regression.unfit(mine, keys))
    ahead = parts[0]
    for p in parts[1:]:
        ahead = ahead.unionByName(p)
    text = lambda c: F.lit(c).cast("string")
    simpler = F.col("model") != model
    each = forecast.steady_band(ahead, keys).withColumns({"scope": F.lit("per_family"), "downgraded_from": F.when(simpler, model), "reason": text(None)})
    columns = ["scope", *keys, "step", "date", "yhat", "lower", "upper", "model", "downgraded_from", "reason"]
    kinds = {f.name: f.dataType for f in each.schema.fields}
    none = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    out = none(failed.withColumn("scope", F.lit(FAILED)))
    if scope != "global":
        out = out.unionByName(each.select(columns))
    if scope != "per_family":
        total = ahead.groupBy("date").agg(F.sum("yhat").alias("yhat")).withColumn("scope", F.lit("global"))
        total = total.withColumns({"step": F.row_number().over(W.partitionBy("scope").orderBy("date")), "model": F.lit(model)})  # a row a date
        out = out.unionByName(none(forecast.steady_band(total, ["scope"])))
    return out


def summary(found: DataFrame, series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for a pipeline of scope both: n_forecast and n_failed series, partial_results, and of the global forecast change_pct and trend.

    The change is that of the last date's total against the last month of the series that have a forecast, over 1 at least;
    without a forecast it is 0.
    """
    ok = found.where("scope = 'per_family' AND step = 1").select(*keys)
    months = series.join(ok, keys, "left_semi").groupBy("date").agg(F.sum(F.col(value).cast("double")).alias("y"))
    last = months.agg(F.max_by("y", "date").alias("last"))
    of = found.agg(
        F.count_if((F.col("scope") == "per_family") & (F.col("step") == 1)).alias("n_forecast"), F.count_if(F.col("scope") == FAILED).alias("n_failed"),
        F.max_by("yhat", F.when(F.col("scope") == "global", F.col("step"))).alias("ahead"),
    )
    change = F.coalesce((F.col("ahead") - F.col("last")) * 100 / F.greatest(F.lit(1.0), F.col("last")), F.lit(0.0))
    return of.withColumn("last", last.scalar()).select("n_forecast", "n_failed", (F.col("n_failed") > 0).alias("partial_results"), change.alias("change_pct"), F.when(change >= 0, "hausse").otherwise("baisse").alias("trend"))
