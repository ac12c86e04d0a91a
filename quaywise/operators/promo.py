"""Promotions: events, elasticity, uplift ladder, similar campaigns, baseline, simulation, scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.functions import calendar
from quaywise.functions.scalar import chain
from quaywise.operators import inventory

# Service (none: any), discount from, to, uplift in percent and dip after the promotion.
ELASTICITY = (
    ("FIBRE", 5.0, 10.0, 8.0, 0.15), ("FIBRE", 10.0, 20.0, 15.0, 0.18), ("FIBRE", 20.0, 30.0, 22.0, 0.22), ("FIBRE", 30.0, 50.0, 30.0, 0.25),
    ("5G", 5.0, 10.0, 6.0, 0.12), ("5G", 10.0, 20.0, 12.0, 0.15), ("5G", 20.0, 30.0, 20.0, 0.20), ("5G", 30.0, 50.0, 28.0, 0.22),
    ("DATA_BUNDLE", 5.0, 10.0, 15.0, 0.25), ("DATA_BUNDLE", 10.0, 20.0, 28.0, 0.30), ("DATA_BUNDLE", 20.0, 30.0, 40.0, 0.35), ("DATA_BUNDLE", 30.0, 50.0, 55.0, 0.40),
    ("VOD", 5.0, 10.0, 12.0, 0.20), ("VOD", 10.0, 20.0, 22.0, 0.25), ("VOD", 20.0, 30.0, 32.0, 0.30), ("VOD", 30.0, 50.0, 42.0, 0.35),
    (None, 5.0, 10.0, 10.0, 0.20), (None, 10.0, 20.0, 20.0, 0.25), (None, 20.0, 30.0, 30.0, 0.30), (None, 30.0, 50.0, 45.0, 0.35),
)
#: Without any row: discount up to, uplift and dip; and beyond.
FALLBACK, BEYOND = ((10.0, 10.0, 0.20), (20.0, 20.0, 0.25), (30.0, 30.0, 0.30)), (45.0, 0.35)
LEAD_DAYS, DIP_DAYS = 14, 14


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def tagged(promos: DataFrame, lead_days: int = LEAD_DAYS, every_year: bool = False) -> DataFrame:
    """Each promotion (promo_start, promo_end) with the first event by priority that overlaps it, a lead before the start
    counting as part of it: Eid el-Fitr, Eid el-Adha, Ramadan, then the fixed ones.

    Fixed events are looked for in the year of the lead's start and the year before, so a promotion over New Year doesn't
    see what follows in January; with every_year, in the year after as well.
    """
    begin, end = F.date_sub("promo_start", lead_days), F.col("promo_end")
    meets = lambda a, b: (begin <= b) & (end >= a)
    cases = [(_any([meets(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in windows]), name) for name, windows in calendar.DATED_EVENTS]
    for name, a, b in calendar.EVENTS:
        years = [F.year(begin) + k for k in ((0, -1, 1) if every_year else (0, -1))]
        cases.append((_any([meets(calendar.of_year(y, a), calendar.of_year(y + int(b < a), b)) for y in years]), name))
    return promos.withColumn("event", chain(cases))


def event_of_start(promos: DataFrame) -> DataFrame:
    """promos with event_type filled, where it is null, by the window that the promotion begins in."""
    d = F.col("promo_start")
    day = F.date_format(d, "MM-dd")
    cases = [(_any([d.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in windows]), name) for name, windows in calendar.DATED_EVENTS]
    cases += [((day >= a) | (day <= b) if b < a else day.between(a, b), name) for name, a, b in calendar.EVENTS if name != "ete"]
    cases.append((F.month(d).isin(6, 7) | day.between("08-01", "08-15"), "ete"))
    return promos.withColumn("event_type", F.coalesce("event_type", chain(cases)))


def elasticity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ELASTICITY, "service_type string, discount_min double, discount_max double, expected_uplift double, post_dip double")


def elasticity(rows: DataFrame, discount: str, service: Column | None = None) -> DataFrame:
    """Uplift and dip of the first band that holds the discount (percent), the service's own before those of any, else those
    of the stated steps. Both ends of a band belong to it, and of two bands the lower one counts."""
    d = F.col(discount)
    code = F.lit(None).cast("string") if service is None else F.upper(service)
    holds = lambda s, a, b: (d.between(a, b) & F.coalesce(code == s, F.lit(False))) if s else d.between(a, b)
    table = [(holds(s, a, b), u, p) for s, a, b, u, p in ELASTICITY] + [(d <= most, u, p) for most, u, p in FALLBACK]
    return rows.withColumns({"expected_uplift": chain([(c, u) for c, u, _ in table], BEYOND[0]), "post_dip": chain([(c, p) for c, _, p in table], BEYOND[1])})


def campaigns(sales: DataFrame) -> DataFrame:
    """Monthly campaigns of a category in a region: mean discount of its promoted sales, and how much more was sold than
    in the category's mean month in the region."""
    month = sales.groupBy(F.trunc("sale_date", "MM").alias("promo_start"), "product_category", "region_label").agg(
        F.sum(F.when(F.col("discount") >= 0.05, F.col("qty")).otherwise(0.0)).alias("promo_qty"), F.sum("qty").alias("qty"), (F.avg(F.when(F.col("discount") >= 0.05, F.col("discount"))) * 100).alias("discount_percent")
    )
    base = F.avg("qty").over(W.partitionBy("product_category", "region_label"))
    return month.where(F.col("discount_percent").isNotNull()).withColumn("actual_uplift", (F.col("qty") - base) * 100 / F.greatest(base, F.lit(1.0)))


def _met(history: DataFrame, asked: DataFrame, band: float) -> DataFrame:
    """Past campaigns of each question's service within `band` points of its discount; what the question asks for has the prefix q_."""
    q = asked.select("question", "service_type", *[F.col(c).alias(f"q_{c}") for c in ("region", "channel", "event_type", "month", "discount")])
    d = F.col("q_discount")
    return history.where(F.col("actual_uplift").isNotNull()).join(q, "service_type").where(F.col("discount_percent").between(F.greatest(F.lit(0.0), d - band), d + band))


def _same(c: str) -> Column:
    """Whether a campaign is of the region (channel) asked for; true where none is."""
    return F.col(f"q_{c}").isNull() | F.coalesce(F.col(c) == F.col(f"q_{c}"), F.lit(False))


def _season() -> Column:
    """Whether a campaign began within a month of the one asked for, in the same year of months: December and January don't meet."""
    m = F.col("q_month")
    return F.month("promo_start").between(F.greatest(F.lit(1), m - 1), F.least(F.lit(12), m + 1))


def uplift_ladder(history: DataFrame, asked: DataFrame, band: float = 7.0) -> DataFrame:
    """For each question (question, service_type, region, channel, event_type, month, discount; region, channel and event may
    be null): the mean uplift of past campaigns within `band` points, from the strictest of seven levels that has two, else one.

    1 event, region, channel; 2 event, region; 3 event; 4 season, region, channel; 5 season, region; 6 season; 7 any. The
    levels of a question are conditional aggregates of one pass over its campaigns.
    """
    event = F.coalesce(F.col("event_type") == F.col("q_event_type"), F.lit(False))
    levels = [event & _same("region") & _same("channel"), event & _same("region"), event, _season() & _same("region") & _same("channel"), _season() & _same("region"), _season(), F.lit(True)]
    each = [F.struct(F.lit(k).alias("level"), F.count_if(c).alias("matches"), F.avg(F.when(c, F.col("actual_uplift"))).alias("uplift")) for k, c in enumerate(levels, 1)]
    by = _met(history, asked, band).groupBy("question").agg(F.array(*each).alias("levels"))
    first = F.coalesce(F.get(F.filter("levels", lambda x: x["matches"] >= 2), F.lit(0)), F.get(F.filter("levels", lambda x: x["matches"] >= 1), F.lit(0)))
    return by.select("question", first.alias("l")).select("question", "l.level", "l.matches", "l.uplift")


def similar(history: DataFrame, asked: DataFrame, k: int = 5, band: float = 7.0) -> DataFrame:
    """The newest k campaigns for each question, of its service, season and band of discounts, and of its event if one is
    asked for, else of its region; `rank` is 1 for the newest."""
    rows = _met(history, asked, band).where(_season() & F.when(F.col("q_event_type").isNotNull(), F.coalesce(F.col("event_type") == F.col("q_event_type"), F.lit(False))).otherwise(_same("region")))
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("promo_start"), "region", "channel", "discount_percent"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("question", "rank", "region", "channel", "event_type", "promo_start", "discount_percent", "actual_uplift")


def stock_snapshot(stock: DataFrame, sales: DataFrame, keys: list[str], as_of: Column) -> DataFrame:
    """Of each key the stock of its own newest snapshot up to the day (columns date, product_id, available_qty,
    avg_monthly_sales); where that is nothing, three times its sales of the last 30 days (column sale_date), 30 at least."""
    newest = stock.where(F.col("date") <= as_of).withColumn("_m", F.max("date").over(W.partitionBy(*keys))).where(F.col("date") == F.col("_m"))
    now = newest.groupBy(*keys).agg(F.sum("available_qty").alias("stock"), F.sum("avg_monthly_sales").alias("monthly"), F.countDistinct("product_id").alias("products"), F.max("date").alias("snapshot_date"))
    recent = sales.where((F.col("sale_date") <= as_of) & (F.col("sale_date") >= F.date_sub(as_of, 30))).groupBy(*keys).agg(F.count("*").alias("recent"))
    both = now.join(recent, keys, "full")
    there, guess = F.coalesce(F.col("stock") > 0, F.lit(False)), F.coalesce("recent", F.lit(0))
    return both.select(
        *keys,
        F.when(there, F.col("stock")).otherwise(F.greatest(F.lit(30), guess * 3)).cast("double").alias("available_stock"),
        F.when(there, F.col("monthly")).otherwise(guess).cast("double").alias("avg_monthly_sales"),
        F.when(there, F.col("products")).otherwise(0).alias("product_count"),
        F.when(there, F.col("snapshot_date")).alias("snapshot_date"),
        F.when(there, "fact_stock").otherwise("estimated_from_sales").alias("source"),
    )


def baseline(promos: DataFrame, points: DataFrame, lead_days: int = 7, flat: Column | None = None) -> DataFrame:
    """The daily demand of each promotion's service (points: service_type, date, value) from four weeks before it to two
    weeks and the lead behind it; `flat` units a day, which are then synthetic, where the service has no demand at all in it.

    Points go to the promotions of their service; days of those without any are generated.
    """
    begin, end = F.date_sub("promo_start", 28), F.date_add("promo_end", DIP_DAYS + lead_days)
    met = promos.join(points, "service_type", "left").withColumn("_in", F.coalesce(F.col("date").between(begin, end), F.lit(False)))
    met = met.withColumn("_any", F.max("_in").over(W.partitionBy("promo_id")))
    known = met.where("_in").withColumn("is_synthetic", F.lit(False))
    none = met.where(~F.col("_any")).dropDuplicates(["promo_id"]).drop("date", "value")
    none = none.withColumn("date", F.explode(F.sequence(begin, end))).withColumns({"value": (F.lit(100.0) if flat is None else flat).cast("double"), "is_synthetic": F.lit(True)})
    return known.unionByName(none).drop("_in", "_any")


def effect(days: DataFrame, start: Column, end: Column, uplift: Column, dip: Column, value: str = "value", dip_days: int = DIP_DAYS) -> DataFrame:
    """Daily demand with the promotion: raised while it runs, lowered (to half at most) for two weeks after it."""
    d = F.col("date")
    during, after = d.between(start, end), (d > end) & (d <= F.date_add(end, dip_days))
    factor = F.when(during, 1 + uplift / 100).when(after, F.greatest(F.lit(0.5), 1 - uplift / 100 * dip)).otherwise(1.0)
    return days.withColumns({"factor": factor, "with_promo": F.col(value) * factor, "phase": chain([(during, "promo"), (after, "dip")], "base")})


def simulated(promos: DataFrame, points: DataFrame, history: DataFrame, lead_days: int = 7, level: float = 0.95) -> DataFrame:
    """What each promotion (promo_id, service_type, region, channel, discount, promo_start, promo_end, current_stock) would
    do: its event, its uplift (of past campaigns where two are alike, else of the elasticity table; `override_uplift` before
    the latter, if there), additional units, and the stock indicators."""
    rows = elasticity(tagged(promos), "discount", F.col("service_type"))
    asked = rows.select(F.col("promo_id").alias("question"), "service_type", "region", "channel", F.col("event").alias("event_type"), F.month("promo_start").alias("month"), "discount")
    past = uplift_ladder(history, asked).select(F.col("question").alias("promo_id"), "matches", "uplift")
    rows = rows.join(past, "promo_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    own = F.col("override_uplift") if "override_uplift" in promos.columns else F.lit(None)
    rows = rows.withColumns(
        {
            "uplift_percent": F.when(F.col("matches") >= 2, F.col("uplift")).otherwise(F.coalesce(own, "expected_uplift")),
            "uplift_source": chain([(F.col("matches") >= 2, "historical"), (own.isNotNull(), "override")], "elasticity_table"),
        }
    )
    keys = ["promo_id", "service_type", "event", "uplift_percent", "uplift_source", "matches", "is_synthetic"]
    days = baseline(rows, points, lead_days, F.greatest(F.lit(1.0), F.col("current_stock") / 30.0))
    days = effect(days, F.col("promo_start"), F.col("promo_end"), F.col("uplift_percent"), F.col("post_dip"))
    more = days.groupBy("promo_id").agg(F.coalesce(F.sum(F.when(F.col("phase") == "promo", F.col("with_promo") - F.col("value"))), F.lit(0.0)).alias("additional_units"))
    days = days.withColumn("value", F.col("with_promo"))
    out = inventory.stock_indicators(days.withColumn("matches", F.col("matches").cast("long")), keys, F.col("current_stock"), F.col("promo_start"), F.col("promo_end"), lead_days, level)
    return out.join(more, "promo_id")


def scenarios(requests: DataFrame, results: DataFrame, created_at: Column) -> DataFrame:
    """Rows to append to the saved scenarios: request and result as JSON (series aren't part of a result), by promo_id."""
    rows = requests.join(results.drop(*[c for c in requests.columns if c != "promo_id"]), "promo_id")
    name = F.concat_ws(" ", F.lit("Simulation"), "service_type", "promo_start")
    pack = lambda columns: F.to_json(F.struct(*[c for c in columns if c != "promo_id"]))
    given = F.col("scenario_name") if "scenario_name" in requests.columns else F.lit(None).cast("string")
    return rows.select("promo_id", F.coalesce(given, name).alias("scenario_name"), pack(requests.columns).alias("request_params"), pack([c for c in results.columns if c not in requests.columns or c == "promo_id"]).alias("results"), created_at.alias("created_at"))


def mirrored(requests: DataFrame, results: DataFrame) -> DataFrame:
    """What simulated promotions add to the promotion facts, so that later ones find them."""
    rows = requests.join(results.select("promo_id", "event", "uplift_percent", "demand", "additional_units"), "promo_id")
    return rows.select("service_type", "region", "channel", F.col("event").alias("event_type"), F.col("discount").alias("discount_percent"), "promo_start", "promo_end", F.col("uplift_percent").alias("actual_uplift"), F.col("demand").alias("units_sold_during"), (F.col("demand") - F.col("additional_units")).alias("baseline_units_expected"), F.concat(F.lit("Simulated: "), "promo_id").alias("notes"))


def outcomes(observed: DataFrame) -> DataFrame:
    """Observed campaigns as rows of the promotion facts, their event by their dates."""
    return tagged(observed).withColumnRenamed("event", "event_type")


def listed(saved: DataFrame, k: int = 20, ids: list | None = None) -> DataFrame:
    """The newest k saved scenarios, or those of the given ids, newest first."""
    rows = saved.orderBy(F.desc("created_at"), "promo_id")
    return rows.limit(k) if ids is None else rows.where(F.col("promo_id").isin(*ids))


def first_active(rows: DataFrame, promos: DataFrame) -> DataFrame:
    """Each row's first promotion by start and id that covers its date, else none (column promo_code).

    The range join goes by month buckets: a promotion is put in every month it touches, so rows meet only those of their month.
    """
    month = lambda c: F.trunc(c, "MM")
    spread = promos.select("service_code", "promo_code", "promo_start", "promo_end", F.explode(F.sequence(month("promo_start"), month("promo_end"), F.expr("interval 1 month"))).alias("_m"))
    rows = rows.withColumn("_m", month("sale_date"))
    met = rows.join(spread, ["service_code", "_m"], "left").withColumn("covers", F.col("sale_date").between(F.col("promo_start"), F.col("promo_end")))
    keys = [c for c in rows.columns if c != "_m"]
    best = F.min(F.when(F.col("covers"), F.struct("promo_start", "promo_code")))
    return met.groupBy(*keys).agg(best.alias("p")).select(*keys, F.col("p.promo_code").alias("promo_code"))


def covered(rows: DataFrame, promos: DataFrame) -> DataFrame:
    """Rows whose service has a promotion on their date (a semi-join on the days that promotions cover)."""
    spread = promos.select(F.col("service_code").alias("_s"), F.explode(F.sequence("promo_start", "promo_end")).alias("_d")).distinct()
    return rows.join(spread, (F.col("service_code") == F.col("_s")) & (F.col("sale_date") == F.col("_d")), "left_semi")


def linked(sales: DataFrame, promos: DataFrame) -> DataFrame:
    """sales with promo_code filled, where it is null, by the first promotion of the service that covers the date."""
    days = sales.where(F.col("promo_code").isNull()).select("service_code", "sale_date").distinct()
    found = first_active(days, promos).select("service_code", "sale_date", F.col("promo_code").alias("_p"))
    return sales.join(found, ["service_code", "sale_date"], "left").withColumn("promo_code", F.coalesce("promo_code", "_p")).drop("_p")
