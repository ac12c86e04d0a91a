"""Series preparation: gap filling, lags, rolling features, repairs, smoothing, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.functions.scalar import all_of, cyclic, ratio
from quaywise.functions import calendar


def over(keys: list[str], order: str = "date") -> W:
    return W.partitionBy(*keys).orderBy(order)


def last_rows(keys: list[str], n: int, order: str = "date") -> W:
    return over(keys, order).rowsBetween(-(n - 1), 0)


def gap_filled(rows: DataFrame, keys: list[str], value: str, unit: str = "day") -> DataFrame:
    """One row for each day (or month) between the first and the last one of a series; missing values are 0."""
    step = F.expr(f"interval 1 {unit}")
    spine = rows.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b")).select(*keys, F.explode(F.sequence("a", "b", step)).alias("date"))
    sums = rows.groupBy(*keys, "date").agg(F.sum(value).alias(value))
    return spine.join(sums, [*keys, "date"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def lags(rows: DataFrame, keys: list[str], value: str, steps: tuple[int, ...] = (1, 2, 3, 12)) -> DataFrame:
    return rows.withColumns({f"lag_{n}": F.lag(value, n).over(over(keys)) for n in steps})


def rolling(rows: DataFrame, keys: list[str], value: str, spans: tuple[int, ...] = (3, 6, 12)) -> DataFrame:
    """Means of the last rows, the current one among them; the deviation of three; volatility, momentum and acceleration."""
    x = F.col(value)
    out = rows.withColumns({f"roll_{n}": F.avg(value).over(last_rows(keys, n)) for n in spans})
    out = out.withColumn("roll_std_3", F.coalesce(F.stddev_samp(value).over(last_rows(keys, 3)), F.lit(0.0)))
    out = out.withColumn("volatility", F.least(F.col("roll_std_3") / (F.col("roll_3") + 1e-6), F.lit(1.0)))
    out = out.withColumn("momentum", x - F.col("roll_3"))
    return out.withColumn("acceleration", F.coalesce(F.col("momentum") - F.lag("momentum").over(over(keys)), F.lit(0.0)))


def calendar_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("date")
    ms, mc = cyclic(F.month(d), 12)
    ws, wc = cyclic(F.weekday(d), 7)
    flags = {"trend_index": F.row_number().over(over(keys)) - 1, "month": F.month(d), "quarter": F.quarter(d), "day_of_week": F.weekday(d), "is_weekend": F.weekday(d) >= 5, "is_holiday": calendar.is_holiday(d), "is_ramadan": calendar.in_windows(d)}
    return rows.withColumns(flags | {"month_sin": ms, "month_cos": mc, "week_sin": ws, "week_cos": wc})


#: Measures that a day or month without sales has none of, and labels that it takes from its neighbours.
MEASURES = ("nb_ventes", "nb_dealers_actifs", "nb_ventes_promo", "pct_ventes_promo", "prix_moyen")
LABELS = ("service_code", "product_id", "product_name", "product_category", "region_key", "region_label")


def dense_sales(rows: DataFrame, keys: list[str], unit: str = "month") -> DataFrame:
    """Sales rows (date, MEASURES, some LABELS) with every day or month between the first and the last one of a series.

    Measures of repeated dates are summed and those of missing ones are 0, the share of promotions is computed anew, and
    labels come from before, else from after, else UNKNOWN.
    """
    measures, labels = [c for c in MEASURES if c in rows.columns], [c for c in LABELS if c in rows.columns and c not in keys]
    spine = rows.groupBy(*keys).agg(F.explode(F.sequence(F.min("date"), F.max("date"), F.expr(f"interval 1 {unit}"))).alias("date"))
    once = rows.groupBy(*keys, "date").agg(*[F.sum(c).cast("double").alias(c) for c in measures], *[F.min(c).alias(c) for c in labels])
    out = spine.join(once, [*keys, "date"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in measures})
    if labels:
        out = out.withColumns({f"_f_{c}": forward(c, keys) for c in labels} | {f"_b_{c}": backward(c, keys) for c in labels})
        out = out.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}", F.lit("UNKNOWN")) for c in labels}).drop(*[f"_{k}_{c}" for k in "fb" for c in labels])
    if {"nb_ventes", "nb_ventes_promo"} <= set(measures):
        out = out.withColumn("pct_ventes_promo", F.when(F.col("nb_ventes") > 0, ratio(F.col("nb_ventes_promo") * 100, F.col("nb_ventes"))).otherwise(0.0))
    return out


def sales_features(rows: DataFrame, keys: list[str], unit: str = "month", promotions: bool = True, price: bool = True, calendar_too: bool = True, services: tuple[str, ...] = ()) -> DataFrame:
    """The feature frame of a dense series: keys, date, the target nb_ventes, and the features of the groups that are switched on.

    Means include the current row. Features that a row has none of take those of the row before, else 0. services are the
    codes that get a 0/1 column each.
    """
    d, y = F.col("date"), F.col("nb_ventes")
    ms, mc = cyclic(F.month(d), 12)
    mean = lambda c, n: F.avg(c).over(last_rows(keys, n))
    made = {"trend_index": F.row_number().over(over(keys)) - 1}
    when = {"month": F.month(d), "quarter": F.quarter(d), "month_sin": ms, "month_cos": mc}
    promo = {"promo_active": (F.col("nb_ventes_promo") > 0).cast("int"), "promo_rate": F.when(y > 0, F.col("nb_ventes_promo") / y).otherwise(0.0)}
    if unit == "month":
        made |= when if calendar_too else {}
        made |= promo if promotions else {}
        made |= {"prix_moyen": F.col("prix_moyen")} if price else {}
        made |= {"nb_dealers_actifs": F.col("nb_dealers_actifs")}
        made |= {f"sales_lag_{n}": F.lag("nb_ventes", n).over(over(keys)) for n in (1, 2, 3, 12)} | {f"sales_roll_{n}": mean("nb_ventes", n) for n in (3, 6, 12)}
        made |= {f"price_roll_{n}": mean("prix_moyen", n) for n in (3, 6, 12)} if price else {}
    else:
        days = {"day_of_week": F.weekday(d), "is_weekend": (F.weekday(d) >= 5).cast("int"), "is_ramadan": calendar.in_windows(d).cast("int"), "is_holiday": calendar.is_holiday(d).cast("int")}
        made |= days | when if calendar_too else {}
        made |= promo if promotions else {}
        made |= {"prix_moyen_lag7": mean("prix_moyen", 7)} if price else {}
        made |= {"nb_dealers_actifs_lag7": mean("nb_dealers_actifs", 7), "nb_dealers_actifs_lag30": mean("nb_dealers_actifs", 30)}
    made |= {f"service_{c}": (F.col("service_code") == c).cast("int") for c in services}
    out = rows.select(*keys, "date", y.alias("nb_ventes"), *[c.alias(f"f_{n}") for n, c in made.items()])
    return out.select(*keys, "date", "nb_ventes", *[F.coalesce(forward(f"f_{n}", keys), F.lit(0)).alias(n) for n in made])


def stock_features(rows: DataFrame, keys: list[str], value: str, unit: str = "month") -> DataFrame:
    """The feature frame of a stock series: lags 1 to 3 and of a season, rolling features, calendar and cycles of the grain."""
    d = F.col("date")
    out = rolling(lags(rows, keys, value, (1, 2, 3)), keys, value).withColumn("lag_seasonal", F.lag(value, 12 if unit == "month" else 7).over(over(keys)))
    out = out.withColumns({"trend_index": F.row_number().over(over(keys)) - 1, "month": F.month(d), "quarter": F.quarter(d)})
    cycles = {"month": (F.month(d), 12)} if unit == "month" else {"dayofweek": (F.weekday(d), 7), "dayofyear": (F.dayofyear(d), 365.25)}
    for name, (x, period) in cycles.items():
        s, c = cyclic(x, period)
        out = out.withColumns({name: x, f"{name}_sin": s, f"{name}_cos": c})
    seen = [c for c in out.columns if c.startswith("lag_")]
    return out.withColumns({f"_{c}": forward(c, keys) for c in seen}).withColumns({c: F.coalesce(f"_{c}", F.lit(0.0)) for c in seen}).drop(*[f"_{c}" for c in seen])


def sales_series(mart: DataFrame, unit: str = "month", service: str | None = None, level: str = "service", member: str | None = None) -> DataFrame:
    """A sales mart (date, LABELS, MEASURES) of one member of a level (service: all; product, category or region), summed and
    averaged by date and made dense: one series."""
    column = {"service": None, "product": "product_id", "category": "product_category", "region": "region_key"}[level]
    if column and not member:
        raise ValueError(f"the level {level} needs a member")
    same = None if column is None else F.lower(F.trim(F.col(column))) == F.lower(F.trim(F.lit(member)))
    rows = mart.where(all_of([None if service is None else F.col("service_code") == service, same]))
    by = rows.groupBy("date").agg(
        *[F.min(c).alias(c) for c in LABELS if c in mart.columns], F.sum("nb_ventes").alias("nb_ventes"), F.avg("nb_dealers_actifs").alias("nb_dealers_actifs"), F.sum("nb_ventes_promo").alias("nb_ventes_promo"), F.avg("pct_ventes_promo").alias("pct_ventes_promo"), F.avg("prix_moyen").alias("prix_moyen")
    )
    return dense_sales(by.withColumn("_k", F.lit(0)), ["_k"], unit).drop("_k")


def forward(value: str, keys: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(over(keys).rowsBetween(W.unboundedPreceding, 0))


def backward(value: str, keys: list[str]) -> Column:
    return F.first(value, ignorenulls=True).over(over(keys).rowsBetween(0, W.unboundedFollowing))


def filled(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Missing values from before, else from after, else 0; and interpolated between the neighbours that are there."""
    at = F.row_number().over(over(keys))
    rows = rows.withColumn("_at", at).withColumn("_seen", F.when(F.col(value).isNotNull(), F.col("_at")))
    rows = rows.withColumns({"_p": forward(value, keys), "_n": backward(value, keys), "_pi": forward("_seen", keys), "_ni": backward("_seen", keys)})
    line = F.col("_p") + (F.col("_n") - F.col("_p")) * F.coalesce(ratio(F.col("_at") - F.col("_pi"), F.col("_ni") - F.col("_pi")), F.lit(0.0))
    return rows.withColumns({"filled": F.coalesce("_p", "_n", F.lit(0.0)), "interpolated": F.coalesce(line, F.col("_p"), F.col("_n"), F.lit(0.0))}).drop("_at", "_seen", "_p", "_n", "_pi", "_ni")


def trailing_zeros_cut(rows: DataFrame, keys: list[str], value: str, least: int = 6) -> DataFrame:
    """Rows up to the last value that isn't 0, the first `least` in any case."""
    rows = rows.withColumn("_i", F.row_number().over(over(keys)))
    last = F.max(F.when(F.abs(F.col(value)) > 1e-9, F.col("_i"))).over(W.partitionBy(*keys))
    return rows.withColumn("_l", F.greatest(F.coalesce(last, F.lit(0)), F.lit(least))).where("_i <= _l").drop("_i", "_l")


def outliers_smoothed(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values beyond 1.5 interquartile ranges become the median of themselves and their neighbours (series of 4 or more)."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(W.partitionBy(*keys))
    near = F.array_sort(F.collect_list(value).over(over(keys).rowsBetween(-1, 1)))
    half = F.size(near) / 2
    median = F.when(F.size(near) % 2 == 1, F.get(near, F.floor(half).cast("int"))).otherwise((F.get(near, (half - 1).cast("int")) + F.get(near, half.cast("int"))) / 2)
    rows = rows.withColumns({"_q": q, "_n": F.count(value).over(W.partitionBy(*keys)), "_m": median})
    rows = rows.withColumns({"lower": F.col("_q")[0] - 1.5 * (F.col("_q")[1] - F.col("_q")[0]), "upper": F.col("_q")[1] + 1.5 * (F.col("_q")[1] - F.col("_q")[0])})
    out = (F.col("_n") >= 4) & ((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))
    return rows.withColumns({"is_outlier": out, "smoothed": F.when(out, F.col("_m")).otherwise(F.col(value))}).drop("_q", "_n", "_m")


def z_normalised(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(x - mean) / sample deviation within the series, a deviation of 0 or null counting as 1; and the way back."""
    w = W.partitionBy(*keys)
    std = F.coalesce(F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumns({"mean": F.avg(value).over(w), "std": std})
    rows = rows.withColumn("z", (F.col(value) - F.col("mean")) / F.col("std"))
    return rows.withColumn("restored", F.greatest(F.lit(0.0), F.col("z") * F.col("std") + F.col("mean")))


def neighbour_mean(value: str, keys: list[str], reach: int = 3) -> Column:
    """Mean of up to `reach` rows on either side without the row itself; of the whole series where there is no neighbour."""
    w = over(keys).rowsBetween(-reach, reach)
    return F.coalesce(ratio(F.sum(value).over(w) - F.col(value), F.count(value).over(w) - 1), F.avg(value).over(W.partitionBy(*keys)))


def month_gaps(rows: DataFrame, keys: list[str], days: int = 45) -> DataFrame:
    rows = rows.withColumn("gap_days", F.datediff("date", F.lag("date").over(over(keys))))
    return rows.where(F.col("gap_days") > days)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the order given, which has to be total."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def seasonal_difference(value: str, keys: list[str], season: int) -> Column:
    return F.col(value) - F.lag(value, season).over(over(keys))


def autocorrelation(rows: DataFrame, keys: list[str], value: str, lag: int = 12) -> DataFrame:
    rows = rows.withColumn("_b", F.lag(value, lag).over(over(keys)))
    return rows.groupBy(*keys).agg(F.corr(value, "_b").alias("autocorr"), F.count("_b").alias("pairs"))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles, linear between two values, of each key: from the number of rows of each value and a running sum of these,
    so that no task holds all values of a key at once."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = counts.withColumns({"_to": F.sum("_n").over(over(keys, value).rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(W.partitionBy(*keys))})
    place = {name: p * (F.col("_all") - 1) for name, p in at.items()}
    first = lambda where: F.min(F.when(F.col("_to") > where, F.col(value)))
    ends = upto.groupBy(*keys).agg(*[e for n, x in place.items() for e in (first(F.floor(x)).alias(f"_a_{n}"), first(F.ceil(x)).alias(f"_b_{n}"), F.max(x - F.floor(x)).alias(f"_w_{n}"))])
    return ends.select(*keys, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_w_{n}")).alias(n) for n in at])
