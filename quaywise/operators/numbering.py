"""Numbers over a whole table without a window that has no key, and what a schema has of what is expected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.session import cut


def row_numbers(df: DataFrame, *order: str | Column, name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """df with the number of each row in this order, from 1 on, as row_number() over (order by ...) has it.

    Rows are dealt out by ranges of the order and sorted inside them, so a task has the rows between two bounds; their place in
    the range comes from Spark's own numbering, and the rows of the ranges before are added: the counts of the ranges, one
    number each, are all that comes to the driver. A hot value is split over ranges by what follows it in the order, so
    the order should end with a key. Rows that are equal in it get numbers in some order.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND((1 << 33) - 1)
    before, seen = {}, 0
    for r in sorted(placed.groupBy(part.alias("p")).count().collect()):
        before[r.p], seen = seen, seen + r["count"]
    if not before:
        return df.withColumn(name, F.lit(0).cast("long"))
    add = F.get(F.lit([before.get(p, 0) for p in range(max(before) + 1)]), part)
    return placed.withColumn(name, add.cast("long") + place + 1).drop("_at")


def dealt(numbered: DataFrame, members: DataFrame, member: str, name: str = "row_number") -> DataFrame:
    """numbered with the members of a dimension in turn: row 1 gets the first, and after the last comes the first again."""
    some = row_numbers(members.select(member).distinct(), member, name="_m")
    count = some.agg(F.count("*")).scalar()
    return numbered.withColumn("_m", (F.col(name) - 1) % count + 1).join(some, "_m").drop("_m")


def presence(tables: dict[str, DataFrame | None], expected: dict[str, tuple[str, ...]]) -> DataFrame:
    """table_name, column_name, present and filled (rows that have a value; null where the column isn't there) for every expected column.

    tables: by name, None for one that doesn't exist (see `there`).
    """
    parts, absent = [], []
    spark = next(t.sparkSession for t in tables.values() if t is not None)
    for name, columns in expected.items():
        df = tables.get(name)
        have = [c for c in columns if df is not None and c in df.columns]
        absent += [(name, c, False, None) for c in columns if c not in have]
        if have:
            counts = df.agg(*[F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate(have)])
            parts.append(counts.select(F.lit(name).alias("table_name"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(True).alias("present"), F.col(f"_{i}").alias("filled")) for i, c in enumerate(have)]))))
    parts.append(spark.createDataFrame(absent, "table_name string, column_name string, present boolean, filled long"))
    return reduce(DataFrame.unionByName, parts)


def there(spark: SparkSession, name: str) -> DataFrame | None:
    """A table of the catalogue, or None."""
    return spark.table(name) if spark.catalog.tableExists(name) else None
