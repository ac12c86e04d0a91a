"""Reading uploads: delimiter and header conventions, routing by columns, normalising sales and stock frames."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.functions.scalar import SERVICES, safe_float, safe_int, safe_str, service_of, valid_msisdn, with_dates, year_month
from quaywise.operators.series import latest
from quaywise.sources import office

# Alternatives for a column, first one present counts; columns that tell the kinds of files apart.
CANDIDATES = {
    "date": ("CREATION_DATE", "DATE", "TRANSACTION_DATE", "SNAPSHOT_DATE", "CREATED_AT"),
    "client": ("MSISDN", "CLIENT_ID"),
    "dealer": ("DEALER_ID", "DEALER", "POINT_VENTE", "DEALER_CODE"),
    "quantity": ("STOCK_QTY", "CURRENT_STOCK_QTY", "STOCK_QUANTITY", "INVENTORY_QTY", "AVAILABLE_QTY", "QTY"),
    "product": ("PRODUCT_ID", "PRODUCT_NAME", "SKU", "ITEM_CODE", "COD_PROD", "PRODUCT_CODE"),
    "warehouse": ("WAREHOUSE_CODE", "WAREHOUSE"),
    "service": ("SERVICE_TYPE", "SERVICE", "TYPE_SERVICE"),
    "offer": ("OFFRE", "OFFRE_CODE", "PLAN_CODE"),
    "promo": ("PROMO_CODE", "PROMOTION_CODE", "PROMO"),
    "family": ("COD_FAM", "PRODUCT_FAMILY", "product_family", "family"),
}
FIVE_G = {"COD_PROD", "QTE_STK", "YEAR_MONTH", "GOVERNORATE"}
LEGACY_STOCK = {"YEAR_MONTH", "PRODUCT_FAMILY", "STOCK_START_OF_PERIOD"}
STOCK_DATES = {"YEAR_MONTH", "STOCK_START_OF_PERIOD", "SNAPSHOT_DATE", "DATE"}
STOCK_QUANTITIES = {"STOCK_QTY", "STOCK_QUANTITY", "CURRENT_STOCK_QTY", "QTE_STK", "CURRENT_STOCK"}
STOCK_PRODUCTS = {"PRODUCT_ID", "PRODUCT_FAMILY", "PRODUCT_NAME", "COD_PROD"}
STOCK_SIGNS = {"STOCK_QTY", "STOCK_QUANTITY", "WAREHOUSE", "WAREHOUSE_CODE"}
PROMO_SIGNS = {"PROMO_CODE", "DISCOUNT_PCT", "PROMOTION"}
#: Columns of a sales row whose words name its service, and those that name its product, first one present counts.
SERVICE_WORDS = ("OFFRE", "PRODUCT_ID", "PRODUCT_NAME", "DESCRIPTION", "LIBELLE")
PRODUCT_IDS = ("OFFRE", "DEBIT", "COD_PROD", "PRODUCT_ID", "SKU", "ITEM_CODE")
#: The place of a line in its upload, as read_table gives it.
LINE = "_LINE"


def header(name: str) -> str:
    return re.sub(r"[ \-/.]", "_", name.strip().upper())


def pick(df: DataFrame, kind: str) -> str | None:
    return next((c for c in CANDIDATES[kind] if c in df.columns), None)


def delimiter(head: str) -> str:
    """The separator that the first line has most of."""
    first = head.lstrip("﻿").splitlines()[0] if head.strip() else ""
    return max(",;\t|", key=lambda d: (first.count(d), -",;\t|".index(d)))


def read_table(spark: SparkSession, path: str, head: str | None = None) -> DataFrame:
    """A delimited file, or the first sheet of a workbook, as strings with normalised headers.

    The head of a delimited file (4096 characters) is read through Spark unless given; of a workbook the heading row is.
    """
    suffix = Path(path).suffix.lower()
    if suffix in (".xlsx", ".xlsm", ".xls"):
        return _read_workbook(spark, path)
    if suffix not in (".csv", ".txt", ".tsv"):
        raise ValueError(f"files of type {suffix or 'none'} can't be read")
    if head is None:
        row = spark.read.text(path).first()
        head = row[0][:4096] if row else ""
    df = spark.read.options(header=True, sep=delimiter(head), encoding="UTF-8").csv(path)
    names = [header(c.lstrip("\ufeff")) for c in df.columns]
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    return df.select("*", line.alias(LINE)).toDF(*names, LINE)


def _read_workbook(spark: SparkSession, path: str) -> DataFrame:
    rows = office.sheet_rows(office.files(spark, path))
    top = rows.orderBy(F.col("error").isNull(), "line").first()
    if top is None:
        raise ValueError("the workbook has no rows")
    if top.error:
        raise ValueError(f"the workbook can't be read: {top.error}")
    lines = office.table(rows.where(F.col("line") > top.line), [f"c{i}" for i in range(len(top.cells))])
    place = F.struct(F.col("path").alias("file_path"), F.lit(0).cast("long").alias("file_block_start"), F.col("line").cast("long").alias("n"))
    return lines.select(*[f"c{i}" for i in range(len(top.cells))], place.alias(LINE)).toDF(*map(header, office.headings(top.cells)), LINE)


def kind_of(columns: list[str]) -> str:
    """stock_5g, stock, promotion or sales, by the columns that are there."""
    have = set(columns)
    if have >= FIVE_G:
        return "stock_5g"
    if have >= LEGACY_STOCK or have & STOCK_DATES and have & STOCK_QUANTITIES and have & STOCK_PRODUCTS or have & STOCK_SIGNS:
        return "stock"
    return "promotion" if have & PROMO_SIGNS else "sales"


def _or_null(df: DataFrame, *names: str) -> Column:
    """The first of the columns that isn't blank; null where none is there."""
    there = [safe_str(F.col(c)) for c in names if c in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def _line(df: DataFrame) -> Column:
    """The order of lines: as read, else as the frame's partitions have them."""
    return F.col(LINE) if LINE in df.columns else F.monotonically_increasing_id()


def _needed(df: DataFrame, kind: str) -> str:
    found = pick(df, kind)
    if found is None:
        raise ValueError(f"the upload has no column for the {kind}: one of {', '.join(CANDIDATES[kind])}")
    return found


def previewed(df: DataFrame, n: int = 5) -> DataFrame:
    """The first lines of an upload."""
    return df.orderBy(_line(df)).limit(n)


def with_service(df: DataFrame, forced: str | None = None) -> DataFrame:
    """df with SERVICE: the one given, else the one stated if it is known, else the first whose words the row has, else UNKNOWN."""
    if forced:
        return df.withColumn("SERVICE", F.lit(forced.upper().strip()))
    stated = F.upper(_or_null(df, *CANDIDATES["service"]))
    words = F.concat_ws(" ", *[_or_null(df, c) for c in SERVICE_WORDS])
    return df.withColumn("SERVICE", F.when(stated.isin(*SERVICES), stated).otherwise(service_of(words)))


def main_service(df: DataFrame, lines: int = 200) -> DataFrame:
    """One row: the service that most of the first lines are of (of equally frequent ones the first by name), else UNKNOWN."""
    head = with_service(df).orderBy(_line(df)).limit(lines).where(F.col("SERVICE") != "UNKNOWN")
    return head.agg(F.coalesce(F.mode("SERVICE", True), F.lit("UNKNOWN")).alias("service"))


def period(df: DataFrame) -> DataFrame:
    """One row: the first and the last day of an upload."""
    column = pick(df, "date")
    rows = df.select(F.lit(None).cast("timestamp").alias("at")) if column is None else with_dates(df, column, "at")
    return rows.agg(F.min("at").cast("date").alias("period_start"), F.max("at").cast("date").alias("period_end"))


def families(df: DataFrame | None, preview: DataFrame | None, stock: DataFrame) -> DataFrame:
    """The product families of an upload: of its file, else of its preview, else of the products in stock (product_family)."""
    for rows in (df, preview):
        column = pick(rows, "family") if rows is not None else None
        if column is not None:
            found = rows.select(safe_str(F.col(column)).alias("family")).where(F.col("family").isNotNull() & (F.upper("family") != "UNKNOWN")).distinct()
            if not found.isEmpty():
                return found
    return stock.select(safe_str(F.col("product_family")).alias("family")).where(F.col("family").isNotNull() & (F.col("family") != "UNKNOWN")).distinct()


def sales_frame(df: DataFrame, forced: str | None = None) -> DataFrame:
    """The valid sales of an upload: those with a date, a known service and, where clients are numbers, a valid number.

    `line` is the order that later rows replace earlier ones in.
    """
    date, client = _needed(df, "date"), _needed(df, "client")
    rows = with_service(with_dates(df, date, "CREATED"), forced).where(F.col("CREATED").isNotNull() & (F.col("SERVICE") != "UNKNOWN"))
    if client == "MSISDN":
        rows = rows.where(valid_msisdn(F.col("MSISDN")))
    dealer = pick(df, "dealer")
    return rows.select(
        F.col("CREATED").alias("created_at"),
        F.col("SERVICE").alias("service_code"),
        _or_null(df, "MSISDN").alias("msisdn"),
        _or_null(df, "CLIENT_ID").alias("client_id"),
        (_or_null(df, dealer) if dealer else F.lit(None).cast("string")).alias("dealer_id"),
        _or_null(df, *CANDIDATES["offer"]).alias("offre_code"),
        _or_null(df, *PRODUCT_IDS).alias("product_id"),
        _or_null(df, *CANDIDATES["promo"]).alias("promo_code"),
        _or_null(df, "CITY").alias("city"),
        _or_null(df, "GOVERNORATE").alias("governorate"),
        _or_null(df, "DELEGATION", "DELEGATION_NAME").alias("delegation"),
        F.coalesce(_or_null(df, "TRANSACTION_TYPE"), F.lit("new_subscription")).alias("transaction_type"),
        _line(df).alias("line"),
    )


def _month_as_written(x: Column) -> Column:
    """A month column as a date: the day counts where it is written."""
    t = F.regexp_replace(F.trim(x.cast("string")), r"[^0-9/\-]", "")
    return F.coalesce(F.to_date(F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t), F.lit("yyyy-MM-dd"))), year_month(t))


def stock_frame(df: DataFrame) -> DataFrame:
    """Period, quantity and keys of a stock upload: the current quantity, else the first other one that there is a column for.

    Rows whose two quantities differ by more than a fifth or lie below 0 go, and so do those without a date, product or
    quantity. The last row by date and line of a month, product, place and dealer stays.
    """
    quantity, product = _needed(df, "quantity"), _needed(df, "product")
    if "STOCK_START_OF_PERIOD" in df.columns:
        rows = with_dates(df, "STOCK_START_OF_PERIOD", "_at")
    elif "YEAR_MONTH" in df.columns:
        rows = df.withColumn("_at", _month_as_written(F.col("YEAR_MONTH")))
    else:
        rows = with_dates(df, _needed(df, "date"), "_at")
    stated = safe_float(F.col(quantity))
    current = safe_float(F.col("CURRENT_STOCK_QTY")) if "CURRENT_STOCK_QTY" in df.columns else F.lit(None).cast("double")
    apart = (current < 0) | (stated < 0) | (F.abs(current - stated) > 0.2 * F.greatest(F.abs(current), F.abs(stated), F.lit(1.0)))
    warehouse = pick(df, "warehouse")
    rows = rows.select(
        F.col("_at").cast("date").alias("snapshot_date"),
        F.trunc("_at", "MM").alias("period"),
        F.coalesce(current, stated).alias("quantity"),
        F.coalesce(apart, F.lit(False)).alias("_bad"),
        safe_str(F.col(product)).alias("product_id"),
        F.coalesce(safe_str(F.col(warehouse)) if warehouse else F.lit(None).cast("string"), F.lit("UNKNOWN")).alias("warehouse"),
        F.coalesce(_or_null(df, "DEALER_ID"), F.lit("")).alias("dealer_id"),
        _line(df).alias("_line"),
    )
    rows = rows.where(~F.col("_bad") & F.col("snapshot_date").isNotNull() & F.col("product_id").isNotNull() & F.coalesce(F.col("quantity") >= 0, F.lit(False)))
    return latest(rows, ["period", "product_id", "warehouse", "dealer_id"], F.desc("snapshot_date"), F.desc("_line")).drop("_bad", "_line")


def stock_5g_frame(df: DataFrame) -> DataFrame:
    """The monthly stock of a product in a governorate: strict YYYY-MM, quantities not below 0, the last row of a key."""
    month = F.when(F.trim("YEAR_MONTH").rlike(r"^\d{4}-\d{2}$"), year_month(F.col("YEAR_MONTH")))
    least = lambda *names: F.greatest(F.lit(0), F.coalesce(safe_int(_or_null(df, *[c for c in names if c in df.columns][:1])), F.lit(0)))
    text = lambda name, default: F.coalesce(_or_null(df, name), F.lit(default))
    is_ = lambda name, word: F.coalesce(F.upper(_or_null(df, name)) == word, F.lit(False)) if name in df.columns else F.lit(True)
    rows = df.select(
        month.alias("month"),
        safe_str(F.col("COD_PROD")).alias("product_id"),
        safe_str(F.col("GOVERNORATE")).alias("governorate"),
        least("QTE_STK").alias("stock"),
        least("SALES_QTY", "QTE_VTE").alias("sold"),
        least("ACTIVATIONS_QTY", "ACTIVATIONS").alias("activations"),
        least("RESERVED_QTY", "QTE_RES").alias("reserved"),
        least("INVENTORY_QTY", "QTE_INV").alias("inventory"),
        least("STOCK_OPENING_QTY", "QTE_DEB_EXE").alias("opening"),
        safe_float(_or_null(df, *[c for c in ("SELLING_PRICE_TTC", "PV_TTC") if c in df.columns][:1])).alias("price"),
        text("DES_PROD", "").alias("product_name"),
        text("COD_FAM", "UNKNOWN").alias("product_family"),
        text("PRODUCT_TYPE", "UNKNOWN").alias("product_type"),
        text("COD_GROUP", "").alias("product_group"),
        is_("FLAG_5G", "5G").alias("flag_5g"),
        is_("ACTIF", "O").alias("is_active"),
        text("DATA_SOURCE", "REAL").alias("data_source"),
        _line(df).alias("_line"),
    )
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("month", "product_id", "governorate")])
    return latest(rows.where(whole), ["month", "product_id", "governorate"], F.desc("_line")).drop("_line")


def rejected_5g(df: DataFrame) -> DataFrame:
    """The rows of an upload that stock_5g_frame has no place for, as they are."""
    month = F.when(F.trim("YEAR_MONTH").rlike(r"^\d{4}-\d{2}$"), year_month(F.col("YEAR_MONTH")))
    return df.where(month.isNull() | safe_str(F.col("COD_PROD")).isNull() | safe_str(F.col("GOVERNORATE")).isNull())
