"""Payloads of models and of text generators: numbers and objects out of loosely written JSON, series of a wanted length."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaywise.functions.scalar import normalised

# Names under which a series or a value may stand.
SERIES_KEYS = ("forecast", "predictions", "prediction", "values", "results", "data", "mean", "value", "yhat")


def json_in(text: str | None, key: str | None = None) -> object:
    """The JSON in a text: of a fenced block, else of the longest span of braces or brackets, else the value of `key`; else None."""
    if not text:
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    spans = [fenced[1]] if fenced else []
    for a, b in ("{}", "[]"):
        if a in text and b in text:
            spans.append(text[text.index(a) : text.rindex(b) + 1])
    for span in sorted(spans, key=len, reverse=True):
        try:
            return json.loads(span)
        except ValueError:
            continue
    if key and (m := re.search(rf"[\"']?{re.escape(key)}[\"']?\s*[:=]\s*(-?\d+(?:\.\d+)?)", text)):
        return {key: float(m[1])}
    return None


def numbers_in(value: object) -> list[float]:
    """The series of numbers in a payload: a list of numbers, of objects, or either under one of the usual names."""
    if isinstance(value, bool) or value is None:
        return []
    if isinstance(value, (int, float)):
        return [float(value)]
    if isinstance(value, list):
        return [x for v in value for x in numbers_in(v)]
    if isinstance(value, dict):
        for k in SERIES_KEYS:
            if k in value and (found := numbers_in(value[k])):
                return found
    return []


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def series_in(text: pd.Series) -> pd.Series:
    """The numbers in a column of texts that hold JSON."""
    return text.map(lambda t: numbers_in(json_in(t)))


def of_length(series: Column, n: int) -> Column:
    """The first n values of a column; a shorter series goes on by its last step (never below 0), a single value is repeated."""
    size = F.size(series)
    last, step = F.element_at(series, -1), F.when(size > 1, F.element_at(series, -1) - F.get(series, size - 2)).otherwise(0.0)
    more = F.transform(F.sequence(F.lit(1), n - size), lambda i: F.greatest(F.lit(0.0), last + step * i))
    return F.when(size >= n, F.slice(series, 1, n)).when(size > 0, F.concat(series, more))


def nearest(asked: DataFrame, text: str, members: DataFrame, member: str, cutoff: float = 0.75) -> DataFrame:
    """asked (distinct texts) with the member most like each, and how much (1 less the edits over the longer length), if that
    is `cutoff` or more; accents, case and blanks aside, the first by name among equals.

    Texts meet the members that they share two letters in a row with, or are equal to: at a cutoff of 0.75 any text that is
    like enough does, as an edit changes two of these pairs at most.
    """
    key = lambda c: normalised(F.col(c))
    pairs = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))))
    left = asked.select(text, key(text).alias("_a")).select("*", F.explode(pairs(F.col("_a"))).alias("_p"))
    right = members.select(member, key(member).alias("_b")).select("*", F.explode(pairs(F.col("_b"))).alias("_p"))
    met = left.join(right, "_p").select(text, member, "_a", "_b").distinct()
    like = 1 - F.levenshtein("_a", "_b") / F.greatest(F.length("_a"), F.length("_b"))
    best = met.withColumn("similarity", like).where(F.col("similarity") >= cutoff).groupBy(text).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col(member).alias("m"))).alias("b"))
    return asked.join(best, text, "left").select(text, F.col("b.m").alias(member), (-F.col("b.s")).alias("similarity"))
