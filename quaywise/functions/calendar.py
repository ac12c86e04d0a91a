"""Calendar tables and event windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Windows of Ramadan for features and for promotions (they differ by a day in places), of the two feasts, holidays
# (month, day), events of the year in order of priority, and the days that an anomaly may lie near, those of the year first.
RAMADAN = (("2023-03-23", "2023-04-21"), ("2024-03-11", "2024-04-09"), ("2025-03-01", "2025-03-30"), ("2026-02-18", "2026-03-19"), ("2027-02-07", "2027-03-08"))
RAMADAN_EVENTS = (
    ("2020-04-24", "2020-05-23"), ("2021-04-13", "2021-05-12"), ("2022-04-02", "2022-05-01"), ("2023-03-23", "2023-04-20"), ("2024-03-11", "2024-04-09"), ("2025-03-01", "2025-03-29"),
    ("2026-02-18", "2026-03-19"), ("2027-02-08", "2027-03-08"), ("2028-01-28", "2028-02-25"), ("2029-01-17", "2029-02-14"), ("2030-01-06", "2030-02-04"),
)
EID_FITR = (
    ("2020-05-24", "2020-05-30"), ("2021-05-13", "2021-05-19"), ("2022-05-02", "2022-05-08"), ("2023-04-21", "2023-04-27"), ("2024-04-10", "2024-04-16"), ("2025-03-30", "2025-04-05"),
    ("2026-03-20", "2026-03-26"), ("2027-03-09", "2027-03-15"), ("2028-02-26", "2028-03-03"), ("2029-02-15", "2029-02-21"), ("2030-02-05", "2030-02-11"),
)
EID_ADHA = (
    ("2020-07-31", "2020-08-06"), ("2021-07-20", "2021-07-26"), ("2022-07-09", "2022-07-15"), ("2023-06-28", "2023-07-04"), ("2024-06-16", "2024-06-22"), ("2025-06-06", "2025-06-12"),
    ("2026-05-27", "2026-06-02"), ("2027-05-16", "2027-05-22"), ("2028-05-05", "2028-05-11"), ("2029-04-24", "2029-04-30"), ("2030-04-14", "2030-04-20"),
)
#: The dated events in order of priority, before those of every year.
DATED_EVENTS = (("eid_fitr", EID_FITR), ("eid_adha", EID_ADHA), ("ramadan", RAMADAN_EVENTS))
HOLIDAYS = ((1, 1), (1, 14), (3, 20), (4, 9), (5, 1), (7, 25), (8, 13), (10, 15))
EVENTS = (("revolution", "01-09", "01-19"), ("nouvel_an", "12-28", "01-07"), ("fete_independance", "03-15", "03-25"), ("fete_nationale", "07-21", "07-29"), ("rentree_scolaire", "08-16", "09-30"), ("ete", "06-15", "08-15"))
NEAREST_DAYS = (
    ("Jour de l'An", "01-01"), ("Fête de l'Indépendance", "03-20"), ("Jour des Martyrs", "04-09"), ("Fête du Travail", "05-01"), ("Fête de la République", "07-25"), ("Fête de la Femme", "08-13"),
    ("Fête de l'Évacuation", "10-15"), ("Anniversaire du Changement", "11-07"), ("Rentrée scolaire", "09-05"), ("Fin d'année scolaire", "06-15"),
    ("Début Ramadan 2024", "2024-03-11"), ("Aïd el-Fitr 2024", "2024-04-10"), ("Aïd el-Adha 2024", "2024-06-17"), ("Début Ramadan 2025", "2025-03-01"), ("Aïd el-Fitr 2025", "2025-03-30"), ("Aïd el-Adha 2025", "2025-06-07"),
    ("Début Ramadan 2026", "2026-02-18"), ("Aïd el-Fitr 2026", "2026-03-20"), ("Aïd el-Adha 2026", "2026-05-27"), ("Début Ramadan 2027", "2027-02-07"), ("Aïd el-Fitr 2027", "2027-03-09"), ("Aïd el-Adha 2027", "2027-05-17"),
    ("Début Ramadan 2028", "2028-01-28"), ("Aïd el-Fitr 2028", "2028-02-26"), ("Aïd el-Adha 2028", "2028-05-05"),
)


def in_windows(d: Column, windows: tuple[tuple[str, str], ...] = RAMADAN) -> Column:
    out = F.lit(False)
    for a, b in windows:
        out = out | d.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return out


def is_holiday(d: Column) -> Column:
    return (F.month(d) * 100 + F.dayofmonth(d)).isin(*[m * 100 + n for m, n in HOLIDAYS])


def dates(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))


def describe(days: DataFrame) -> DataFrame:
    """The calendar dimension of a table of dates; weeks are ISO, dow is 0 on Sunday."""
    d = F.col("date")
    return days.select(
        "date",
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        (F.dayofweek(d) - 1).alias("dow"),
        F.quarter(d).alias("quarter"),
        F.weekofyear(d).alias("week"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"),
        is_holiday(d).alias("is_holiday"),
        in_windows(d).alias("is_ramadan"),
        F.month(d).isin(6, 7, 8).alias("is_summer"),
    )


def of_year(year: Column, month_day: str) -> Column:
    """The date of a month and day ("MM-DD") in a year."""
    return F.make_date(year, F.lit(int(month_day[:2])), F.lit(int(month_day[3:])))
