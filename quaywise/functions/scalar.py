"""Column expressions: safe casts, dates, text normalisation, classification, cyclic encodings."""

from __future__ import annotations

import math
import re
import statistics
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Services and the words that name them, in order; tiers; intents.
SERVICES = {
    "FIBRE": ("FIBER", "FIBRE", "FTTH", "OPTIC", "FIBRE_OPTIQUE"),
    "5G": ("5G", "FIXE JDID", "JDID", "HOME_5G"),
    "DATA_BUNDLE": ("DATA", "GO", "GB", "BUNDLE", "INTERNET MOBILE"),
    "VOD": ("VOD", "VIDEO", "STREAM", "IPTV", "TV"),
}
BLANKS = ("", "nan", "none", "nat")
TRUE_WORDS = ("true", "1", "yes", "y", "on", "t")
TIERS = {"Premium": ("PREMIUM", "PRO", "BUSINESS", "ENTREPRISE"), "High-Speed": ("500", "1000", "2000", "HAUT", "HIGH"), "Standard": ("100", "200", "300", "STANDARD", "REGULAR")}
DRIVERS = {
    "sales_roll_3": "momentum commercial recent (moyenne des 3 dernieres periodes)",
    "sales_roll_6": "tendance commerciale sur 6 periodes",
    "sales_roll_12": "tendance annuelle lisse",
    "sales_lag_1": "niveau de ventes de la periode precedente",
    "sales_lag_2": "niveau de ventes deux periodes avant",
    "sales_lag_3": "niveau de ventes trois periodes avant",
    "sales_lag_12": "saisonnalite annuelle",
    "nb_dealers_actifs": "couverture et activite du reseau de dealers",
    "nb_ventes_promo": "volume de ventes sous promotion",
    "pct_ventes_promo": "poids des promotions dans les ventes",
    "prix_moyen": "prix moyen des offres vendues",
    "month": "effet calendrier mensuel",
    "month_sin": "saisonnalite intra-annuelle",
    "month_cos": "saisonnalite intra-annuelle",
    "quarter": "effet trimestre",
    "trend_index": "tendance de fond",
}
#: Letters that are another one with marks, and that one (NFKD without the marks), for lower-cased text.
_FOLDED = {chr(c): base for c in range(0xC0, 0x2000) if len(base := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)}
#: How a date may be written: year first, or (where no value of a column is) day first.
YEAR_FIRST = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")
DAY_FIRST = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")


def six(x: Column) -> Column:
    """x to six digits, halves up: floor(x * 1e6 + 0.5) / 1e6, the rule that results are compared by."""
    return F.floor(x * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, null (or the default) where b is 0."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def chain(cases: list[tuple[Column, object]], default: object = None) -> Column:
    """CASE WHEN over (condition, value) pairs in order."""
    first, *rest = cases
    out = reduce(lambda w, c: w.when(c[0], F.lit(c[1]) if not isinstance(c[1], Column) else c[1]), rest, F.when(first[0], F.lit(first[1]) if not isinstance(first[1], Column) else first[1]))
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), where x is computed once and not wherever f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def all_of(conditions: list[Column | None]) -> Column:
    """Conjunction of the conditions that are given; true without any."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def safe_str(x: Column) -> Column:
    t = F.trim(x.cast("string"))
    return F.when(~F.lower(t).isin(*BLANKS), t)


def safe_float(x: Column) -> Column:
    return F.nanvl(safe_str(x).try_cast("double"), F.lit(None).cast("double"))


def safe_int(x: Column) -> Column:
    """Truncates towards zero, as through a float."""
    return safe_float(x).try_cast("bigint")


def safe_bool(x: Column) -> Column:
    return F.coalesce(F.lower(safe_str(x)).isin(*TRUE_WORDS), F.lit(False))


def year_month(x: Column) -> Column:
    """First of the month from YYYYMM, MM/YYYY, YYYY-MM or YYYY-MM-DD; null otherwise."""
    t = F.trim(x.cast("string"))
    shape = chain(
        [
            (t.rlike(r"^\d{6}$"), F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 5, 2), F.lit("-01"))),
            (t.rlike(r"^\d{1,2}/\d{4}$"), F.concat(F.element_at(F.split(t, "/"), -1), F.lit("-"), F.lpad(F.element_at(F.split(t, "/"), 1), 2, "0"), F.lit("-01"))),
            (t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))),
            (t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.concat(F.substring(t, 1, 7), F.lit("-01"))),
        ]
    )
    return F.to_date(F.try_to_timestamp(shape, F.lit("yyyy-MM-dd")))


def month_start(d: Column) -> Column:
    return F.trunc(d.cast("date"), "MM")


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def normalised(x: Column) -> Column:
    """Lower-cased, without accents, `_` and `-` as spaces, white space collapsed."""
    plain = F.regexp_replace(F.translate(F.lower(x), "".join(_FOLDED), "".join(_FOLDED.values())), r"\p{M}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[_-]", " "), r"\s+", " "))


def read_date(text: Column, form: str) -> Column:
    """The timestamp in a text of the given form. The shape is looked at first, as what can't be read costs the parser an exception."""
    parts = re.findall(r"'[^']*'|[A-Za-z]+|[^A-Za-z']+", form)
    shape = "".join(re.escape(p.strip("'")) if not p[0].isalpha() else r"[+-]?\d{4,}" if p == "yyyy" else rf"\d{{{len(p)}}}" for p in parts)
    return F.when(text.rlike(f"(?i)^{shape}$"), F.try_to_timestamp(text, F.lit(form)))


def with_dates(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with `name`, the timestamp in a text column: year first; day first only if no value of the column is year first."""
    text = F.trim(F.col(column).cast("string"))
    read = lambda formats: once(text, lambda t: F.coalesce(*[read_date(t, f) for f in formats]))
    some = rows.agg(F.count(read(YEAR_FIRST))).scalar()
    return rows.withColumn(name, F.when(some > 0, read(YEAR_FIRST)).otherwise(read(DAY_FIRST)))


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def service_of(x: Column, default: str = "UNKNOWN") -> Column:
    """The first service one of whose words occurs in the text."""
    return once(F.upper(F.coalesce(x.cast("string"), F.lit(""))), lambda t: chain([(_has_any(t, words), name) for name, words in SERVICES.items()], default))


def service_alias(code: Column) -> Column:
    """The service's code in the warehouse: DATA stands for DATA_BUNDLE."""
    return F.when(F.upper(code) == "DATA", "DATA_BUNDLE").otherwise(F.upper(code))


def tier_of(x: Column) -> Column:
    """Product tier by words in its name."""
    t = F.upper(F.coalesce(x.cast("string"), F.lit("")))
    return chain([(_has_any(t, words), name) for name, words in TIERS.items()], "Service")


def driver_label(feature: Column) -> Column:
    """What a feature of a forecast means to a business; its name in words where that isn't stated."""
    return chain([(feature == f, label) for f, label in DRIVERS.items()], F.replace(feature, F.lit("_"), F.lit(" ")))


def citation(source: Column, page: Column, chunk: Column) -> Column:
    return F.format_string("%s#p%s-c%s", source, page.cast("string"), chunk.cast("string"))


def valid_msisdn(x: Column) -> Column:
    """Digits only; with the prefix 216 at least 11, else at least 8."""
    digits = F.regexp_replace(F.coalesce(safe_str(x), F.lit("")), r"\D", "")
    return F.when(F.startswith(digits, F.lit("216")), F.length(digits) >= 11).otherwise(F.length(digits) >= 8)


def percent_in(x: Column) -> Column:
    """The first percentage in a text, which may be negative, as a fraction."""
    return F.regexp_extract(x, r"(-?\d+(?:\.\d+)?)\s*%", 1).try_cast("double") / 100


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def inverse_normal(p: float) -> float:
    return statistics.NormalDist().inv_cdf(p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays, null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
