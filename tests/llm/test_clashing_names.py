"""Extra columns under the names that stages work with keep their values through the whole pipeline."""

from collections import Counter

import corpus_pipeline as pipe
import odd
import pytest
from pyspark.sql import functions as F

NAMES = (
    "size target budget before cell sub copies whole h edge fit place _c _u _s _k _h _n _q _m _fp _score _mix _limit _place _copy _copies _text _key block words kept "
    "c n bands key root hub token_ids n_tokens score label held_out predicted a b doc start"
).split() + ["a.b", "x y", "b`t", "c.d.e", "`q`"]


def frame(spark):
    rows = [(i, " ".join(odd.words(i % 30, 60 + i % 7)), "en", f"s{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in NAMES])


@pytest.mark.parametrize("k", range(len(pipe.STAGES)))
def test_values_stay(spark, k):
    docs = frame(spark)
    out = pipe.STAGES[k][1](spark, docs, odd.DATA)
    assert out.columns[: len(docs.columns)] == docs.columns and len(out.columns) == len(docs.columns) + 2 * (k == 4)
    rows = out.collect()
    assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in NAMES)
    if k == 4:
        assert {"token_ids_", "n_tokens_"} <= set(out.columns)


def test_ties_of_the_mix_do_not_depend_on_the_order_of_rows(spark):
    rows = [(7, f"w{i} x y z", "a", i) for i in range(40)] + [(None, f"v{i} x y z", "a", i) for i in range(40)] + [(100 + i, "b " * 9, "b", i) for i in range(60)]
    got = set()
    for order in (rows, rows[::-1], rows[1::2] + rows[::2]):
        df = spark.createDataFrame(order, "doc_id long, text string, source string, x int").repartition(3)
        got.add(tuple(sorted(Counter(r.text for r in pipe.mix_sources(spark, df, "").collect()).items())))
    assert len(got) == 1
