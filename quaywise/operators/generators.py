"""Generators that go on from the given tables: earlier months of a stock, replenished step by step."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaywise.functions.scalar import chain


def synthetic_history(stock: DataFrame, keys: list[str], months: int = 24, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """The months before each series' first one: demand from its trend, season and noise, and a stock that is filled up to
    two months' demand whenever it would fall below one. Steps depend on the one before, so a series is a group; noise is
    seeded by the series' key."""
    kinds = {f.name: f.dataType.simpleString() for f in stock.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", month date, sold double, on_hand double, received double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        y = pdf["sold"].to_numpy(float)
        first = pd.Timestamp(pdf["month"].iloc[0])
        phase = np.array([pd.Timestamp(m).month for m in pdf["month"]])
        mean = max(y.mean(), 0.01)
        season = {m: (y[phase == m].mean() if (phase == m).any() else mean) / mean for m in range(1, 13)}
        slope = np.polyfit(np.arange(len(y)), y, 1)[0] if len(y) > 1 else 0.0
        rng = np.random.default_rng([seed, zlib.crc32("|".join(str(pdf[k].iloc[0]) for k in keys).encode())])
        rows, stock_now = [], 2 * mean
        for i in range(months, 0, -1):
            month = first - pd.DateOffset(months=i)
            sold = max(0.0, (mean - slope * (i + len(y) / 2)) * season[month.month] * (1 + noise * rng.standard_normal()))
            received = max(0.0, 2 * mean - stock_now) if stock_now - sold < mean else 0.0
            stock_now = max(0.0, stock_now + received - sold)
            rows.append((month.date(), sold, stock_now, received))
        out = pd.DataFrame(rows, columns=["month", "sold", "on_hand", "received"])
        return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "month", "sold", "on_hand", "received"]]

    return stock.select(*keys, "month", "sold").groupBy(*keys).applyInPandas(one, schema)


# What a month adds to the usual volume of sales.
MONTH_FACTORS = {8: 1.22, 9: 1.22, 6: 1.10, 7: 1.10, 12: 1.10, 1: 0.85}


def spine(months: DataFrame, places: DataFrame, products: DataFrame) -> DataFrame:
    """Every month, place and product: small dimensions, of which the smaller ones are gathered in an array for each row of the first."""
    gathered = lambda t: t.agg(F.collect_list(F.struct(*t.columns))).scalar()
    rows = months.withColumns({"_a": gathered(places), "_b": gathered(products)})
    rows = rows.select(*months.columns, "_b", F.inline("_a"))
    return rows.select(*months.columns, *places.columns, F.inline("_b"))


def volumes(cells: DataFrame, base: Column, growth: float, first_year: int) -> DataFrame:
    """Cells (month, weight) with the number of sales of each: base, weight, growth by year and the month's factor, 1 at least."""
    month = F.month("month")
    factor = chain([(month == m, f) for m, f in MONTH_FACTORS.items()], 1.0)
    volume = base * F.col("weight") * F.pow(F.lit(growth), (F.year("month") - first_year).cast("double")) * factor
    return cells.withColumn("n_rows", F.greatest(F.lit(1), F.floor(volume + 0.5).cast("int")))


def expanded(cells: DataFrame) -> DataFrame:
    """One row for each of a cell's n_rows sales, numbered within the cell; ids come from the cell and this number, so that no
    sequence over all rows is needed."""
    return cells.withColumn("row_in_month", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))


def stock_levels(cells: DataFrame, base: Column, growth: float, first_year: int) -> DataFrame:
    """Cells (month, weight) with a stock to the nearest five, what is free of it, its limits and flags."""
    level = base * F.col("weight") * F.pow(F.lit(growth), (F.year("month") - first_year).cast("double"))
    rows = cells.withColumn("stock_quantity", F.greatest(F.lit(2), F.floor(level / 5 + 0.5).cast("int") * 5))
    share = lambda part: F.floor(base * F.col("weight") * part + 0.5).cast("int")
    rows = rows.withColumns({"available_qty": F.greatest(F.lit(0), F.floor(F.col("stock_quantity") * 0.9 + 0.5).cast("int")), "stock_min_threshold": F.greatest(F.lit(2), share(0.15)), "stock_max_capacity": share(2.5)})
    return rows.withColumns({"is_rupture": F.col("stock_quantity") <= F.col("stock_min_threshold"), "is_low_stock": F.col("stock_quantity") <= F.greatest(F.lit(2), share(0.25)), "overstock_risk": F.col("stock_quantity") >= share(2.2)})
