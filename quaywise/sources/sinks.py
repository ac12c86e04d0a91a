"""Writes as table functions: upserts, insert-ignore, dimension merges, retention. Each gives the table as it is to be written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(current: DataFrame, incoming: DataFrame, key: list[str], replaced: list[str], order: str = "seq") -> DataFrame:
    """The current rows, and those that come in by `order`: of equal keys the first gives its columns but for the
    replaced ones, which the last one gives. Rows with a null in the key never meet another: each has a number of its own in
    the grouping, so that all rows go through one aggregation and what they come from is computed once."""
    rows = current.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    rows = rows.withColumn("_alone", F.when(~whole, F.monotonically_increasing_id()))
    place = F.struct("_side", order)
    others = [c for c in current.columns if c not in key]
    agg = [(F.max_by if c in replaced else F.min_by)(c, place).alias(c) for c in others]
    return rows.groupBy(*key, "_alone").agg(*agg).select(current.columns)


def inserted(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows are added where their key isn't there."""
    return current.unionByName(incoming.dropDuplicates(key).join(current, key, "left_anti").select(current.columns))


def dimension_merged(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """A dimension in which new values that aren't null come before the old ones."""
    others = [c for c in current.columns if c != key]
    new = incoming.select(key, *[F.col(c).alias(f"_n_{c}") for c in others])
    return current.join(new, key, "full").select(key, *[F.coalesce(f"_n_{c}", c).alias(c) for c in others])


def replaced(current: DataFrame, incoming: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """The table in which incoming rows take the place of those of their key, of several the last one by `order`: stored
    limits, reviews and explanations of anomalies, cached forecasts, chunks of a source."""
    new = incoming if order is None else incoming.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in current.columns if c not in key])
    return current.join(new, key, "left_anti").select(current.columns).unionByName(new.select(current.columns))


def deleted(current: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the rows of the given keys."""
    return current.join(keys, keys.columns, "left_anti").select(current.columns)


def of_pairs(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the table whose key is one of the given ones: whole keys, not any combination of their parts."""
    return table.join(pairs.distinct(), pairs.columns, "left_semi")


# Columns that a repeated key takes from the last row; all others stay those of the first.
SALES_KEY, SALES_REPLACED = ["msisdn", "created_at", "service_code"], ["dealer_id", "geo_id", "offre_code", "promo_code", "batch"]
STOCK_KEY = ["date", "product_id", "warehouse"]
STOCK_REPLACED = (
    "stock_quantity current_stock_qty available_qty reserved_qty inventory_qty avg_monthly_sales sell_through_rate days_of_supply "
    "is_rupture is_low_stock understock_risk overstock_risk batch last_updated"
).split()
STOCK_5G_REPLACED = "stock_quantity current_stock_qty inventory_qty reserved_qty sales_qty activations_qty stock_opening_qty flag_5g product_type data_source batch last_updated".split()


def stock_facts(frame: DataFrame, batch: str, low: int = 10, high: int = 500) -> DataFrame:
    """The rows that a normalised stock upload (stock_frame) adds to the stock facts; limits are those of any product."""
    q = F.col("quantity").cast("long")
    return frame.select(
        F.col("snapshot_date").alias("date"), "product_id", "warehouse", F.nullif("dealer_id", F.lit("")).alias("dealer_id"), q.alias("stock_quantity"), q.alias("current_stock_qty"), q.alias("available_qty"), F.lit(0).cast("long").alias("reserved_qty"), q.alias("inventory_qty"),
        (q <= 0).alias("is_rupture"), (q < low).alias("is_low_stock"), (q < low).alias("understock_risk"), (q > high).alias("overstock_risk"), (q <= 0).alias("has_zero_stock"), F.lit(batch).alias("batch"),
    )


def geo_key(*parts: Column) -> Column:
    """The key of a place from its city, governorate and delegation; a missing part is a part like any other, so a place without
    a city is found again."""
    return F.xxhash64(*[F.coalesce(F.lower(F.trim(p)), F.lit("\0")) for p in parts])


def geo_ensured(geo: DataFrame, rows: DataFrame) -> DataFrame:
    """The places (geo_id, city, governorate, delegation) with those of the rows; rows without city and governorate have none."""
    new = rows.where(F.coalesce("city", "governorate").isNotNull()).select("city", "governorate", "delegation").distinct()
    new = new.groupBy(geo_key(*map(F.col, ("city", "governorate", "delegation"))).alias("geo_id")).agg(*[F.min(c).alias(c) for c in ("city", "governorate", "delegation")])
    return geo.unionByName(new.join(geo.select("geo_id"), "geo_id", "left_anti"))


def governorates_resolved(rows: DataFrame, geo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with the geo_id of their governorate (upper or lower case and outer blanks aside, the smallest of several), and the
    places with what had to be added for it."""
    clean = F.coalesce(F.nullif(F.lower(F.trim("governorate")), F.lit("")), F.lit("unknown"))
    known = geo.where(F.col("governorate").isNotNull()).groupBy(F.lower(F.trim("governorate")).alias("_g")).agg(F.min("geo_id").alias("_id"))
    named = rows.withColumn("_g", clean)
    new = named.select("_g").distinct().join(known, "_g", "left_anti").select(geo_key(F.lit(None).cast("string"), F.col("_g"), F.lit(None).cast("string")).alias("_id"), "_g")
    every = known.select("_g", "_id").unionByName(new.select("_g", "_id"))
    added = new.select(F.col("_id").alias("geo_id"), F.lit(None).cast("string").alias("city"), F.col("_g").alias("governorate"), F.lit(None).cast("string").alias("delegation"))
    return named.join(every, "_g").withColumnRenamed("_id", "geo_id").drop("_g"), geo.unionByName(added)


def promos_ensured(promos: DataFrame, rows: DataFrame, as_of: Column) -> DataFrame:
    """The promotions (promo_code, promo_name, promo_type, discount_pct, promo_start, promo_end) with new ones of an upload:
    without a start they start on the day, without an end (or an unreadable one) they end with their start."""
    start = F.coalesce(F.try_to_date(F.col("PROMO_START")), as_of)
    end = F.when(F.col("PROMO_END").isNull(), as_of).otherwise(F.coalesce(F.try_to_date(F.col("PROMO_END")), start))
    new = rows.where(F.col("PROMO_CODE").isNotNull()).select(
        F.col("PROMO_CODE").alias("promo_code"), F.coalesce("PROMO_NAME", "PROMO_CODE").alias("promo_name"), F.coalesce("PROMO_TYPE", F.lit("discount")).alias("promo_type"), F.col("DISCOUNT_PCT").try_cast("double").alias("discount_pct"), start.alias("promo_start"), end.alias("promo_end")
    )
    return inserted(promos, new, ["promo_code"])


def already_loaded(facts: DataFrame, source_file: str) -> DataFrame:
    """One row if a file has been loaded: its rows and period (and no row if it hasn't)."""
    return facts.where(F.col("source_file") == source_file).agg(F.count("*").alias("rows"), F.min("date").alias("period_start"), F.max("date").alias("period_end")).where("rows > 0")


def loaded(current: DataFrame, incoming: DataFrame, source_file: str, replace: bool = False) -> DataFrame:
    """The facts with those of a file: in place of all others if asked for, unchanged if the file has been loaded before."""
    if replace:
        return incoming
    return current.unionByName(incoming.join(current.where(F.col("source_file") == source_file).select("source_file").limit(1), "source_file", "left_anti").select(current.columns))


def cached(cache: DataFrame, entries: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """A cache (cache_key, payload, expires_at) with new entries (cache_key, payload), which are valid for so many hours."""
    return replaced(cache, entries.withColumn("expires_at", as_of + F.make_dt_interval(F.lit(0), F.lit(hours))), ["cache_key"])


def valid(cache: DataFrame, as_of: Column) -> DataFrame:
    """Entries that haven't expired."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def forecast_key(session: Column, service: Column, level: Column, member: Column) -> Column:
    """What a forecast is known by, whatever its model and horizon."""
    return F.concat(session, F.lit(":forecast:svc="), F.coalesce(service, F.lit("ALL")), F.lit(":tl="), level, F.lit(":tv="), F.coalesce(member, F.lit("ALL")))


def retained(table: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    return table.where(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def exported(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """Both in the columns of the export file: date, type, value, lower, upper, model."""
    none = lambda t: F.lit(None).cast(t)
    h = history.select("date", F.lit("historical").alias("type"), F.col("value").cast("double").alias("value"), none("double").alias("lower"), none("double").alias("upper"), none("string").alias("model"))
    return h.unionByName(forecast.select("date", F.lit("forecast").alias("type"), F.col("yhat").alias("value"), "lower", "upper", "model"))
