"""The months before a stock's first one, step by step: demand from trend and season, and a stock that is filled up when it runs low.

A series is described by one aggregation (`described`): its trend, twelve seasonal indices, ratio of activations and first
stock. Its earlier months are then a fold inside the row (`backcast`): the state is the stock and the months so far, so
there is no Python and no second shuffle, and a series is no longer than the months asked for. Noise is a number that
follows from the key and the month (MD5), the same in every run and on every machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months of demand below which a stock is filled up, and the least and most months that it is filled up by; the
# least share of the first stock that the earliest one has, the least stock; reserved units a unit sold, units counted and
# opening units; and the relative noise of sales, activations, reserved, counted and opening units.
FILLED_BELOW, FILLED_BY = 2.0, (3.5, 5.0)
LEAST_SHARE, LEAST_STOCK = 0.3, 10.0
RESERVED, COUNTED = 0.12, 1.05
NOISE = {"sold": 0.08, "activations": 0.05, "reserved": 0.10, "counted": 0.05, "opening": 0.03}
_OUT = ("month", "sold", "activations", "reserved", "received", "on_hand", "counted", "opening")


def uniform(what: str, month: Column, key: Column) -> Column:
    """A number from 0 up to 1 that follows from a name, a month and a key: the first 32 bits of their MD5."""
    text = F.concat_ws("|", F.lit(what), F.date_format(month, "yyyy-MM"), key)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def _whole(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def described(stock: DataFrame, keys: list[str]) -> DataFrame:
    """Of monthly rows (keys, month, sold, activations, on_hand; the first day of the month, one row each), a row a series:
    first month, intercept, slope, season (indices of January to December, 1 where unknown), ratio, first_stock.

    Nulls count as nothing; the trend is that of least squares over calendar months from the first one, flat for a series of
    one month; the ratio is 0.82 where nothing was sold. Rows without a month are left out.
    """
    c = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    rows = stock.where(F.col("month").isNotNull()).select(*keys, "month", c("sold").alias("y"), c("activations").alias("a"), c("on_hand").alias("s"))
    m = (F.year("month") * 12 + F.month("month")).cast("double")
    of_month = [F.struct(F.sum(F.when(F.month("month") == i, F.col("y"))).alias("y"), F.sum(F.when(F.month("month") == i, 1.0)).alias("n")) for i in range(1, 13)]
    sums = rows.groupBy(*keys).agg(
        F.min("month").alias("first"), F.min(m).alias("m0"), F.count("*").cast("double").alias("n"), F.sum("y").alias("y"), F.sum("a").alias("a"), F.sum(m).alias("m"), F.sum(m * m).alias("mm"), F.sum(m * F.col("y")).alias("my"),
        F.min_by("s", "month").alias("first_stock"), F.array(*of_month).alias("by"),
    )
    spread = F.col("n") * F.col("mm") - F.col("m") * F.col("m")
    slope = F.when(spread > 0, (F.col("n") * F.col("my") - F.col("m") * F.col("y")) / spread).otherwise(0.0)
    mean = F.col("y") / F.col("n")
    out = sums.withColumns({"slope": slope, "mean": mean}).withColumn("intercept", F.col("mean") - F.col("slope") * (F.col("m") / F.col("n") - F.col("m0")))
    season = F.transform("by", lambda b: F.coalesce(F.when((F.col("mean") > 0) & (b["n"] > 0), b["y"] / b["n"] / F.col("mean")), F.lit(1.0)))
    return out.select(*keys, "first", "intercept", "slope", season.alias("season"), F.when(F.col("y") > 0, F.col("a") / F.col("y")).otherwise(0.82).alias("ratio"), "first_stock")


def backcast(stock: DataFrame, keys: list[str], months: int = 24) -> DataFrame:
    """keys and, for each of so many months before a series' first one: month, sold, activations, reserved, received (what filled
    the stock up), on_hand (at the month's end), counted, opening (with what was received). Whole units."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    noisy = lambda x, what, month: x * (1 + NOISE[what] * (2 * uniform(what, month, F.col("_key")) - 1))

    def step(state: Column, i: Column) -> Column:
        month = F.add_months("first", -i)
        usual = F.greatest(F.lit(1.0), (F.col("intercept") - F.col("slope") * i) * F.get("season", F.month(month) - 1))
        sold = F.greatest(F.lit(1.0), _whole(noisy(usual, "sold", month)))
        low, high = FILLED_BY
        fill = _whole(usual * (low + (high - low) * uniform("fill", month, F.col("_key"))))
        received = F.when(state["stock"] < FILLED_BELOW * usual, fill).otherwise(0.0)

        def told(e: Column) -> Column:
            opening = state["stock"] + e["received"]
            on_hand = F.greatest(F.lit(0.0), opening - e["sold"])
            values = [
                e["month"], e["sold"], _whole(noisy(e["sold"] * F.col("ratio"), "activations", e["month"])), _whole(noisy(e["sold"] * RESERVED, "reserved", e["month"])), e["received"],
                on_hand, _whole(noisy(on_hand * COUNTED, "counted", e["month"])), _whole(noisy(opening, "opening", e["month"])),
            ]
            row = F.struct(*[v.alias(n) for v, n in zip(values, _OUT, strict=True)])
            return F.struct(on_hand.alias("stock"), F.concat(state["rows"], F.array(row)).alias("rows"))

        # a lambda over one element names the month's numbers, so that they aren't spelt out again wherever they are used
        return F.transform(F.array(F.struct(month.alias("month"), sold.alias("sold"), received.alias("received"))), told)[0]

    share = F.greatest(F.lit(LEAST_SHARE), 1 - F.col("slope") * months / F.greatest(F.col("intercept"), F.lit(1.0)))
    start = F.greatest(F.lit(LEAST_STOCK), F.col("first_stock") * share)
    none = F.expr(f"cast(array() as array<struct<{', '.join(f'{n}: ' + ('date' if n == 'month' else 'double') for n in _OUT)}>>)")
    rows = described(stock, keys).withColumns({"_key": key, "_start": F.struct(start.alias("stock"), none.alias("rows"))})
    return rows.select(*keys, F.inline(F.aggregate(F.sequence(F.lit(months), F.lit(1), F.lit(-1)), F.col("_start"), step, lambda s: s["rows"])))
