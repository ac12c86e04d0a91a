"""Anomalies of a series: residual scores, rules, merging, summaries, nearest events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.functions.calendar import of_year
from quaywise.functions.scalar import all_of, chain, ratio
from quaywise.operators.series import neighbour_mean


# The types of anomalies, what may have caused them and what to do.
DATA_QUALITY, SPIKE, DROP, GRADUAL = "Data Quality Issue", "Unexpected Spike", "Unexpected Drop", "Gradual Anomaly"
ACTIONS = {
    DATA_QUALITY: "Validate data source integrity and correct if necessary. Check ETL pipeline for ingestion errors.",
    SPIKE: "Verify promotion activity and adjust forecast. Ensure stock levels are sufficient to sustain demand.",
    DROP: "Check inventory status, logistics pipeline and network health. Escalate to supply chain team.",
    GRADUAL: "Monitor trend over next 7 days. Cross-reference with competitor activity and pricing changes.",
}
CAUSES = {
    SPIKE: "Hausse anormale des ventes — promotion flash, activation en masse de dealers ou effet viral probable.",
    DROP: "Baisse anormale des ventes — rupture de stock, incident réseau ou perturbation logistique probable.",
    DATA_QUALITY: "Ventes nulles enregistrées alors que la période voisine est non nulle — erreur ETL ou panne système POS probable.",
    GRADUAL: "Dérive progressive des ventes — pression concurrentielle, changement tarifaire ou churn saisonnier probable.",
}
ACTIONS_OF_REVIEW = ("reviewed", "dismissed", "escalated")


def scored(rows: DataFrame, keys: list[str], value: str, threshold: float = 2.5, residual: str | None = None) -> DataFrame:
    """Rows whose residual lies `threshold` deviations off or that are 0 in a series that isn't; with expected value (the
    mean of up to three neighbours on either side), type, severity and score. Series of fewer than 3 rows have none."""
    w = W.partitionBy(*keys)
    r = residual or value
    std = F.coalesce(F.nullif(F.stddev_samp(r).over(w), F.lit(0.0)), F.lit(1.0))
    rows = rows.withColumns({"z": (F.col(r) - F.avg(r).over(w)) / std, "_n": F.count("*").over(w), "_mean": F.avg(value).over(w), "expected": neighbour_mean(value, keys)})
    zero = (F.col(value) == 0) & (F.col("_mean") > 0)
    hit = rows.where((F.col("_n") >= 3) & (zero | (F.abs("z") >= threshold)))
    return hit.withColumns(
        {
            "anomaly_type": chain([((F.col(value) == 0) & (F.col("expected") > 0), DATA_QUALITY), (F.col("z") >= threshold, SPIKE), (F.col("z") <= -threshold, DROP)], GRADUAL),
            "severity": F.when(zero | (F.abs("z") >= 1.2 * threshold), "high").otherwise("medium"),
            "score": F.when(zero, 0.9).otherwise(F.least(F.lit(1.0), F.abs("z") / (2 * threshold))),
            "variance_pct": F.coalesce(ratio((F.col(value) - F.col("expected")) * 100, F.col("expected")), F.lit(-100.0)),
        }
    ).drop("_n", "_mean")


def advised(found: DataFrame) -> DataFrame:
    """Anomalies with what to do about their type."""
    return found.withColumn("action_recommended", chain([(F.col("anomaly_type") == k, v) for k, v in ACTIONS.items()], "Investigate manually."))


def explained(found: DataFrame) -> DataFrame:
    """Anomalies (anomaly_type, has_rupture, event) with a cause where no document says more: a rupture of stock, else that of
    the type, with the event that it coincides with."""
    cause = chain([(F.col("anomaly_type") == k, v) for k, v in CAUSES.items()], "Cause indéterminée — investigation manuelle requise.")
    return found.withColumn("cause", F.when(F.col("has_rupture"), "Rupture de stock confirmée").when(F.col("event").isNotNull(), F.concat(cause, F.lit(" Coïncide avec l'événement : "), F.col("event"), F.lit("."))).otherwise(cause))


def selected(found: DataFrame, order: list[str], severity: str | None = None, kind: str | None = None, k: int = 50) -> DataFrame:
    """The k anomalies of the highest score, of a severity and a type if given; ties in the order of the given columns."""
    keep = all_of([None if severity in (None, "all") else F.col("severity") == severity, None if kind in (None, "all") else F.col("anomaly_type") == kind])
    return found.where(keep).orderBy(F.desc("score"), *order).limit(k)


def most_urgent(found: DataFrame, order: list[str], k: int = 10) -> DataFrame:
    """The first k anomalies, those of high severity before the others."""
    return found.orderBy(F.when(F.col("severity") == "high", 0).otherwise(1), *order).limit(k)


def decomposed(rows: DataFrame, keys: list[str], value: str, period: int = 12) -> DataFrame:
    """Classical decomposition as windows: centred mean as trend, mean of each phase as season, and the rest; series of
    fewer than two periods and a row keep their values as residuals."""
    w = W.partitionBy(*keys).orderBy("date")
    rows = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy(*keys)), "trend": F.avg(value).over(w.rowsBetween(-(period // 2), period // 2))})
    rows = rows.withColumn("_d", F.col(value) - F.col("trend"))
    rows = rows.withColumn("season", F.avg("_d").over(W.partitionBy(*keys, F.col("_i") % period)))
    return rows.withColumn("residual", F.when(F.col("_n") >= 2 * period + 1, F.col("_d") - F.col("season")).otherwise(F.col(value))).drop("_i", "_n", "_d")


def _local_lines(y: np.ndarray, weights: np.ndarray, span: int) -> np.ndarray:
    """Each value from a weighted straight line through its `span` nearest neighbours (tricube weights)."""
    n, out = len(y), np.empty(len(y))
    x = np.arange(n, dtype=float)
    for i in range(n):
        far = np.abs(x - i)
        reach = np.sort(far)[min(span, n) - 1] + 1
        w = np.clip(1 - (far / reach) ** 3, 0, None) ** 3 * weights + 1e-12
        mean = np.average(x, weights=w)
        spread = np.average((x - mean) ** 2, weights=w)
        level = np.average(y, weights=w)
        slope = np.average((x - mean) * (y - level), weights=w) / spread if spread > 1e-9 else 0.0
        out[i] = level + slope * (i - mean)
    return out


def stl_residual(y: np.ndarray, period: int, rounds: int = 3) -> np.ndarray:
    """Residuals of a robust decomposition: phases and trend smoothed in turn, outliers weighing less each round.

    Series of fewer than two periods and a row are given back as they are.
    """
    y = np.asarray(y, float)
    n = len(y)
    if n < 2 * period + 1:
        return y
    trend, season, weights = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range(rounds):
        for phase in range(period):
            own = slice(phase, None, period)
            season[own] = _local_lines((y - trend)[own], weights[own], 7)
        season -= np.convolve(np.pad(season, period // 2, mode="wrap"), np.ones(period) / period, "same")[period // 2 : period // 2 + n]
        trend = _local_lines(y - season, weights, int(1.5 * period) | 1)
        rest = np.abs(y - trend - season)
        weights = np.clip(1 - (rest / (6 * np.median(rest) + 1e-12)) ** 2, 0, None) ** 2
    return y - trend - season


def stl(rows: DataFrame, keys: list[str], value: str, period: int = 12) -> DataFrame:
    """rows with the residual of a robust decomposition, a series a group."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", residual double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(residual=stl_residual(pdf[value].to_numpy(float), period))

    return rows.groupBy(*keys).applyInPandas(one, schema)


def forest_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Isolation scores (0 to 1, higher for rows that are split off early)."""
    rng, n = np.random.default_rng(seed), len(x)
    size = min(sample, n)
    deep = int(np.ceil(np.log2(max(size, 2))))
    usual = lambda m: 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m if m > 2 else float(m == 2)
    total = np.zeros(n)
    for _ in range(trees):
        todo = [(rng.choice(n, size, replace=False), np.arange(n), 0)]
        while todo:
            own, rows, depth = todo.pop()
            spread = np.ptp(x[own], axis=0) if len(own) else np.zeros(x.shape[1])
            if depth >= deep or len(own) < 2 or not spread.any():
                total[rows] += depth + usual(len(own))
                continue
            f = rng.choice(np.flatnonzero(spread))
            cut = rng.uniform(x[own, f].min(), x[own, f].max())
            todo += [(own[x[own, f] < cut], rows[x[rows, f] < cut], depth + 1), (own[x[own, f] >= cut], rows[x[rows, f] >= cut], depth + 1)]
    return 2.0 ** (-total / trees / max(usual(size), 1e-9))


def isolated(rows: DataFrame, keys: list[str], value: str, price: str, residual: str, contamination: float = 0.08, least: float = 0.55) -> DataFrame:
    """Rows that an isolation forest over value, price, month, day of year and residual sets apart, a series a group."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", forest_score double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")  # so that the trees don't depend on the order of a shuffle
        d = pd.to_datetime(pdf["date"])
        x = np.column_stack([pdf[value], pdf[price], d.dt.month, d.dt.dayofyear, pdf[residual]]).astype(float)
        x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
        raw = forest_scores(x) if len(x) >= 10 else np.zeros(len(x))
        low, high = raw.min(), raw.max()
        scaled = (raw - low) / (high - low) if high > low else np.ones(len(x))
        keep = (raw >= np.quantile(raw, 1 - contamination)) & (scaled >= least) & (len(x) >= 10)
        return pdf.assign(forest_score=scaled)[keep]

    return rows.groupBy(*keys).applyInPandas(one, schema)


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both passes (columns keys, date, score, method), one row a key and date with the higher score; a second pass that
    beats the first one makes it `combined`."""
    both = first.withColumn("_pass", F.lit(1)).unionByName(second.withColumn("_pass", F.lit(2)))
    return both.groupBy(*keys, "date").agg(
        F.max("score").alias("score"),
        F.when(F.max(F.when(F.col("_pass") == 2, F.col("score"))) > F.max(F.when(F.col("_pass") == 1, F.col("score"))), F.lit("combined")).otherwise(F.min_by("method", "_pass")).alias("method"),
    )


def summary(found: DataFrame, keys: list[str]) -> DataFrame:
    """Anomalies by severity and type, and the share that both passes found (percent)."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    both = count("method", "combined") if "method" in found.columns else F.lit(0)
    return found.groupBy(*keys).agg(
        F.count("*").alias("total"),
        count("severity", "high").alias("high_severity"),
        count("severity", "medium").alias("medium_severity"),
        count("anomaly_type", SPIKE).alias("spikes"),
        count("anomaly_type", DROP).alias("drops"),
        count("anomaly_type", DATA_QUALITY).alias("data_quality"),
        (both * 100 / F.count("*")).alias("detection_accuracy_pct"),
    )


def flagged(series: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The series by date with what is known of the anomaly of the highest score on it, if any (ties by key)."""
    best = found.groupBy("date").agg(F.max_by(F.struct("anomaly_type", "severity", "z", "expected", "score"), F.struct("score", *keys)).alias("b"))
    total = series.groupBy("date").agg(F.sum(value).alias("total"))
    return total.join(best, "date", "left").select("date", "total", F.col("b").isNotNull().alias("is_anomaly"), "b.anomaly_type", "b.severity", "b.z", "b.expected", "b.score")


def without_reviewed(found: DataFrame, reviews: DataFrame) -> DataFrame:
    return found.join(reviews.where(F.col("action").isin("reviewed", "dismissed")).select("anomaly_id"), "anomaly_id", "left_anti")


def nearest_event(rows: DataFrame, days: tuple[tuple[str, str], ...], within: int = 15) -> DataFrame:
    """The nearest event within so many days: dated ones, and those of every year in the row's own; of equally near ones the one listed first."""
    on = lambda d: F.lit(d).cast("date") if len(d) == 10 else of_year(F.year("date"), d)
    each = F.array(*[F.struct(F.abs(F.datediff("date", on(d))).alias("days"), F.lit(i).alias("ord"), F.lit(n).alias("event")) for i, (n, d) in enumerate(days)])
    near = F.array_min(F.filter(each, lambda e: e["days"] <= within))
    return rows.withColumn("_e", near).withColumns({"event": F.col("_e.event"), "event_days": F.col("_e.days")}).drop("_e")
