"""Replenishment: demand segments, stock formulas, risks, thresholds, transfers; all column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.functions.scalar import chain, inverse_normal, ratio

# Months of lead and least order by type of product, z by level of service, the levels of promotions.
LEAD = {"SUBSCRIPTION": 0.5, "CPE_HARDWARE": 2.0, "SMARTPHONE_HW": 1.5}
LEAST_ORDER = {"SUBSCRIPTION": 1, "CPE_HARDWARE": 5, "SMARTPHONE_HW": 10}
Z = {0.85: 1.04, 0.90: 1.28, 0.95: 1.65, 0.98: 2.05, 0.99: 2.33}
PROMO_LEVELS = (0.90, 0.95, 0.98, 0.99)
NATIONAL = "NATIONAL"


def by_type(table: dict[str, float], default: float) -> Column:
    return chain([(F.col("product_type") == k, v) for k, v in table.items()], default)


def z_of(level: float, strict: bool = True) -> float:
    """z of a level of service; of a level that isn't in the table an error, or that of 0.95."""
    for known, z in Z.items():
        if abs(level - known) < 0.001:
            return z
    if strict:
        raise ValueError(f"the level of service has to be one of {sorted(Z)}")
    return Z[0.95]


def nearest_level(level: float) -> float:
    return min(PROMO_LEVELS, key=lambda x: abs(x - level))


def scope_key(scope: str) -> Column:
    """What a stock row is counted under: its family, its type (else the family), or its governorate and type."""
    family = F.coalesce("product_family", F.lit("UNKNOWN"))
    kind = F.coalesce(F.nullif(F.trim("product_type"), F.lit("")), family)
    place = F.coalesce(F.nullif(F.trim("governorate"), F.lit("")), F.lit("UNKNOWN"))
    return {"national": family, "by_product_type": kind, "by_governorate": F.concat_ws(" | ", place, kind)}[scope]


def target_of(target: str) -> Column:
    demand = F.coalesce("sales_qty", F.lit(0)) + F.coalesce("activations_qty", F.lit(0))
    return {"demand": demand, "stock": F.coalesce("stock_qty", F.lit(0))}[target].cast("double")


def history(facts: DataFrame, unit: str = "month", target: str = "stock", scope: str = "national", service: str | None = None) -> DataFrame:
    """date, scope key, type, governorate, value, records, real and simulated records of the stock facts.

    By month the last row of a key, month and product counts; by day all do. facts: date, product_id, product_family,
    product_type, governorate, service_code, stock_qty, sales_qty, activations_qty, data_source.
    """
    rows = facts if service is None else facts.where(F.col("service_code") == service)
    kind = F.coalesce(F.nullif(F.trim("product_type"), F.lit("")), "product_family", F.lit("UNKNOWN"))
    rows = rows.select(
        "product_id",
        F.col("date").alias("_day"),
        (F.trunc("date", "MM") if unit == "month" else F.col("date")).alias("date"),
        scope_key(scope).alias("key"),
        kind.alias("product_type"),
        F.coalesce(F.nullif(F.trim("governorate"), F.lit("")), F.lit(NATIONAL)).alias("governorate"),
        target_of(target).alias("value"),
        (F.coalesce("data_source", F.lit("REAL")) == "REAL").alias("real"),
    )
    if unit == "month":
        last = F.row_number().over(W.partitionBy("key", "date", "product_id").orderBy(F.desc("_day"), "governorate"))
        rows = rows.withColumn("_r", last).where("_r = 1")
    return rows.groupBy("date", "key", "product_type", "governorate").agg(F.sum("value").alias("value"), F.count("*").alias("records"), F.count_if("real").alias("real_count"), F.count_if(~F.col("real")).alias("simulated_count"))


def dense_enough(rows: DataFrame, key: str, value: str, months: int = 6) -> DataFrame:
    """Rows of the keys that have so many values above 0."""
    return rows.withColumn("_n", F.count_if(F.col(value) > 0).over(W.partitionBy(key))).where(F.col("_n") >= months).drop("_n")


def demand_segments(facts: DataFrame, scope: str = "by_governorate", months: int = 3) -> DataFrame:
    """Of each segment the mean demand (sales and activations) of its last months (at least 0.01) and its values in order, and
    its stock at the last date of its family, 0 if it has none then.

    A family's last date comes from a window over its dates, one row a segment and date.
    """
    kind = F.coalesce(F.nullif(F.trim("product_type"), F.lit("")), F.lit("UNKNOWN")) if scope != "national" else F.lit("UNKNOWN")
    place = F.coalesce(F.nullif(F.trim("governorate"), F.lit("")), F.lit(NATIONAL)) if scope == "by_governorate" else F.lit(NATIONAL)
    keys = ["product_family", "product_type", "governorate"]
    demand = F.coalesce("sales_qty", F.lit(0)) + F.coalesce("activations_qty", F.lit(0))
    rows = facts.select(F.col("product_family"), kind.alias("product_type"), place.alias("governorate"), "date", demand.alias("demand"), F.coalesce("stock_qty", F.lit(0)).alias("stock"))
    days = rows.groupBy(*keys, "date").agg(F.sum("demand").alias("demand"), F.sum("stock").alias("stock"))
    days = days.withColumn("_last", F.max("date").over(W.partitionBy("product_family")))
    by = days.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg(F.sum("demand").cast("double").alias("demand"), F.sum(F.when(F.col("date") == F.col("_last"), F.col("stock"))).alias("stock"), F.max(F.when(F.col("date") == F.col("_last"), F.col("date"))).alias("stock_date"))
    recent = by.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("month"))))
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= months, F.struct("month", "demand")))), lambda x: x["demand"])
    return recent.groupBy(*keys).agg(
        F.greatest(F.lit(0.01), F.avg(F.when(F.col("_r") <= months, F.col("demand")))).alias("avg_monthly_demand"),
        values.alias("recent_demand"),
        F.greatest(F.lit(0), F.coalesce(F.max("stock"), F.lit(0)).cast("long")).alias("current_stock"),
        F.max("stock_date").alias("stock_date"),
    )


def flat_forecast(avg: Column, months: int = 6) -> Column:
    """The mean demand, to two digits, for each month to come."""
    return F.array_repeat(F.round(avg, 2), months)


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _whole(x: Column) -> Column:
    """Towards zero."""
    return x.cast("long")


def rejected(segments: DataFrame) -> DataFrame:
    """segments with the first reason why no recommendation can be made (null where there is none)."""
    return segments.withColumn("rejected", chain([(F.col("current_stock") < 0, "current_stock"), (F.col("avg_monthly_demand") <= 0, "avg_monthly_demand"), (F.size("forecast_series") < 3, "forecast_series")]))


def recommended(segments: DataFrame, z: float = Z[0.95]) -> DataFrame:
    """Safety stock, reorder point, target, quantity, coverage, risks, trend, confidence and urgency of each segment.

    Segments bring product_type, current_stock, avg_monthly_demand and forecast_series; lead_months, least_order, the
    limits stock_min and stock_max, real_months and simulated_months may be there, too, and may be null.
    """
    own = lambda c: F.col(c) if c in segments.columns else F.lit(None)
    v, avg, n = F.col("forecast_series"), F.col("avg_monthly_demand"), F.size("forecast_series")
    off = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - avg) * (x - avg))
    std = F.when(n <= 1, 0.1).otherwise(F.greatest(F.lit(0.1), F.sqrt(off / F.greatest(n - 1, F.lit(1)))))
    rows = segments.withColumns({"lead_months": F.coalesce(own("lead_months"), by_type(LEAD, 1.0)), "least_order": F.coalesce(own("least_order"), by_type(LEAST_ORDER, 1)), "demand_std": std})
    rows = rows.withColumn("safety_stock", F.when(F.col("lead_months") <= 0, F.lit(0)).otherwise(F.ceil(F.lit(z) * F.col("demand_std") * F.sqrt("lead_months"))))
    rows = rows.withColumn("target_stock", F.aggregate(v, F.lit(0).cast("bigint"), lambda s, x: s + _whole(x)) + F.col("safety_stock"))
    lacking = F.greatest(F.lit(0), F.col("target_stock") - F.col("current_stock"))
    step = F.greatest(F.col("least_order"), F.lit(1))
    rows = rows.withColumn("order_qty", F.ceil(lacking / step) * step)
    low, high = own("stock_min").cast("long"), own("stock_max").cast("long")
    rows = rows.withColumn("safety_stock", F.greatest(F.col("safety_stock"), F.coalesce(low, F.col("safety_stock"))))
    rows = rows.withColumn("reorder_point", F.greatest(F.lit(0), F.ceil(F.greatest(F.lit(0.0), avg) * F.greatest(F.lit(0.0), F.col("lead_months")) + F.col("safety_stock"))))
    rows = rows.withColumn("target_stock", F.least(F.col("target_stock"), F.coalesce(high, F.col("target_stock"))))
    room = F.when(high.isNotNull(), F.greatest(F.lit(0), high - F.col("current_stock")))
    rows = rows.withColumn("order_qty", F.least(F.col("order_qty"), F.coalesce(room, F.col("order_qty"))))
    stock, point, target = F.col("current_stock"), F.col("reorder_point"), F.col("target_stock")
    cover = F.when(avg <= 0, 999.0).otherwise(stock / avg)
    half = F.floor(n / 2).cast("int")
    part = lambda x, size: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: s + _whole(y)) / size
    early, late = part(F.slice(v, 1, half), half), part(F.slice(v, half + 1, n - half), n - half)
    real, simulated = F.coalesce(own("real_months").cast("double"), F.lit(0.0)), F.coalesce(own("simulated_months").cast("double"), F.lit(0.0))
    share = F.coalesce(ratio(real * 100, real + simulated), F.lit(0.0))
    rows = rows.withColumns(
        {
            "coverage_months": cover,
            "days_of_supply": F.when(avg <= 0, 999.0).otherwise(stock / avg * 30),
            "rupture_risk": chain([(stock <= point, "CRITICAL"), (stock <= point * 1.5, "HIGH"), (stock <= point * 2.0, "MEDIUM")], "LOW"),
            "overstock_risk": chain([(target <= 0, "LOW"), (stock >= target * 2.0, "HIGH"), (stock >= target * 1.5, "MEDIUM")], "LOW"),
            "demand_trend": F.when(n < 3, "STABLE").otherwise(chain([(late > early * 1.1, "INCREASING"), (late < early * 0.9, "DECREASING")], "STABLE")),
            "forecast_confidence": chain([(real + simulated == 0, "LOW"), (share >= 80, "HIGH"), (share >= 40, "MEDIUM")], "LOW"),
            "data_source": chain([((real == 0) & (simulated == 0), "UNKNOWN"), (simulated == 0, "REAL"), (real == 0, "SIMULATED")], "MIXED"),
        }
    )
    risk = F.col("rupture_risk")
    return rows.withColumn("urgency", chain([(risk == "CRITICAL", "IMMEDIATE"), (risk == "HIGH", "THIS_WEEK"), ((F.col("order_qty") > 0) | (risk == "MEDIUM"), "THIS_MONTH")], "NO_ACTION"))


def with_limits(segments: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """Stored limits of stock by segment; what the segment itself brings comes first."""
    rows = segments.join(limits.select(*keys, F.col("stock_min").alias("_min"), F.col("stock_max").alias("_max")), keys, "left")
    own = [c in segments.columns for c in ("stock_min", "stock_max")]
    return rows.withColumns({"stock_min": F.coalesce("stock_min", "_min") if own[0] else F.col("_min"), "stock_max": F.coalesce("stock_max", "_max") if own[1] else F.col("_max")}).drop("_min", "_max")


def transfers(rows: DataFrame) -> DataFrame:
    """For each segment at risk that is to be ordered for: the other governorate that has the most to spare of its type
    (TRANSFERT), or for a critical one without any, SUBSTITUTION.

    Donors have a low or medium risk, more than three months of coverage (to two digits) and stock above their reorder
    point; national segments neither give nor get. One donor may serve several. Only a type's two best governorates can
    serve anyone (the second where the first is the recipient's own), so donors are cut to two a type before the join.
    """
    spare = F.col("current_stock") - F.col("reorder_point")
    rows = rows.where(F.col("governorate") != NATIONAL)
    donors = rows.where(F.col("rupture_risk").isin("LOW", "MEDIUM") & (F.round("coverage_months", 2) > 3.0) & (spare > 0))
    donors = donors.groupBy("product_type", F.col("governorate").alias("donor")).agg(F.max(F.struct(spare.alias("excess"), F.col("current_stock").alias("donor_stock"))).alias("d"))
    rank = F.row_number().over(W.partitionBy("product_type").orderBy(F.desc("d.excess"), "donor"))
    donors = donors.withColumn("_r", rank).where("_r <= 2")
    needy = rows.where(F.col("rupture_risk").isin("CRITICAL", "HIGH") & (F.col("order_qty") > 0)).select("product_family", "product_type", "governorate", "rupture_risk", "order_qty")
    best = F.min(F.when(F.col("donor") != F.col("governorate"), F.struct("_r", "donor", "d")))
    met = needy.join(donors, "product_type", "left").groupBy("product_family", "product_type", "governorate", "rupture_risk", "order_qty").agg(best.alias("b"))
    kind = chain([(F.col("b").isNotNull(), "TRANSFERT"), (F.col("rupture_risk") == "CRITICAL", "SUBSTITUTION")])
    out = met.select("product_family", "product_type", "governorate", kind.alias("suggestion"), F.col("b.donor").alias("donor"), F.col("b.d.excess").alias("excess"), F.when(F.col("b").isNotNull(), F.least(F.col("b.d.excess"), F.col("order_qty"))).alias("transfer_qty"))
    return out.where(F.col("suggestion").isNotNull())


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Segments, critical and high risks, overstocks, what is to be ordered, and segments that need nothing."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("total_products"),
        is_("rupture_risk", "CRITICAL").alias("critical_rupture_count"),
        is_("rupture_risk", "HIGH").alias("high_rupture_count"),
        is_("overstock_risk", "HIGH").alias("overstock_count"),
        F.sum("order_qty").alias("total_qty_to_order"),
        is_("urgency", "NO_ACTION").alias("no_action_count"),
    )


def restock(facts: DataFrame, scope: str = "by_product_type", months: int = 3, level: float = 0.95, horizon: int = 6) -> DataFrame:
    """Recommendations of all segments, each with its mean demand as its forecast; months and horizon lie between 1 and 12."""
    months, horizon = max(1, min(12, months)), max(1, min(12, horizon))
    segments = demand_segments(facts, scope, months)
    return recommended(segments.withColumn("forecast_series", flat_forecast(F.col("avg_monthly_demand"), horizon)), z_of(level, strict=False))


#: What segments have in common that the same documents apply to.
PROFILE = ["product_type", "lead_months", "rupture_risk", "overstock_risk", "demand_trend"]


def profiles(rows: DataFrame) -> DataFrame:
    """One row a profile of recommendations, with the words to search documents for; results are joined back on PROFILE."""
    risk, over, trend = F.col("rupture_risk"), F.col("overstock_risk"), F.col("demand_trend")
    words = F.concat_ws(
        " ",
        F.concat(F.lit("politique stock securite "), F.lower(F.replace("product_type", F.lit("_"), F.lit(" ")))),
        F.concat(F.lit("lead time "), F.col("lead_months").cast("string"), F.lit(" mois reapprovisionnement seuil")),
        F.when(risk.isin("CRITICAL", "HIGH"), "rupture stock urgence commande immediate"),
        F.when(over == "HIGH", "surstock exces inventaire reduction"),
        chain([(trend == "INCREASING", "tendance hausse demande croissante ajustement seuil"), (trend == "DECREASING", "tendance baisse demande revision objectif stock")]),
    )
    return rows.groupBy(*PROFILE).agg(F.count("*").alias("segments")).withColumn("query_text", words)


def stock_indicators(days: DataFrame, keys: list[str], stock: Column, start: Column, end: Column, lead_days: int = 7, level: float = 0.95) -> DataFrame:
    """Of each key's daily demand with a promotion (columns date, value): safety, need, gap, coverage, risk and what to order by when.

    stock, start and end are columns that are the same in all rows of a key.
    """
    z = inverse_normal(level)
    d, inside, before = F.col("date"), F.col("date").between(start, end), F.col("date") < start
    rows = days.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(before, F.col("value"))), F.lit(0.0)).alias("daily_before"),
        F.avg(F.when(inside, F.col("value"))).alias("daily"),
        F.sum(F.when(inside, F.col("value"))).alias("demand"),
        F.stddev_pop(F.when(inside, F.col("value"))).alias("std"),
        F.count(F.when(inside, d)).alias("days"),
        F.max(stock).cast("double").alias("stock"),
        F.max(start).alias("promo_start"),
        F.greatest(F.lit(1), F.datediff(F.max(end), F.max(start)) + 1).alias("duration"),
    )
    rows = rows.withColumn("daily", F.coalesce("daily", "daily_before")).withColumn("demand", F.coalesce("demand", F.col("daily") * F.col("duration")))
    std = F.when(F.col("days") > 1, F.col("std")).otherwise(F.col("daily") * 0.15)
    rows = rows.withColumn("safety", F.greatest(F.lit(0.0), F.lit(z) * std * F.sqrt(F.lit(float(lead_days)))))
    rows = rows.withColumns({"reorder_point": F.col("daily") * lead_days + F.col("safety"), "required": F.col("demand") + F.col("safety")}).withColumn("gap", F.col("required") - F.col("stock"))
    cover = lambda c: F.least(F.lit(999.0), ratio(F.col("stock"), F.col(c), 999.0))
    rows = rows.withColumns({"coverage_before": cover("daily_before"), "coverage": cover("daily")})
    share, lacks = F.col("coverage"), F.col("gap") > 0
    return rows.withColumns(
        {
            "risk": chain([(share > F.col("duration") * 1.5, "low"), (share > F.col("duration"), "medium"), (share > F.col("duration") * 0.5, "high")], "critical"),
            "reorder_qty": F.when(lacks, F.col("gap") + F.col("safety")),
            "order_by": F.when(lacks, F.date_sub("promo_start", lead_days)),
        }
    ).drop("std", "days")
