"""The index groups a document's words where the document is; words are stemmed once."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from quaywise.operators import fulltext as ft


def test_words_with_places_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "rouge vert"), (2, "rouge")], "doc_id long, text string")
    plan = ft.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(term" not in plan


def test_both_stemmers_agree(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("aerséxu1ß𝒳") for _ in range(rng.randrange(1, 12))) for _ in range(3000)] + ["chevaux", "aaaaaa", "vendéers"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", ft.stemmed(F.col("w")).alias("s")).collect()
    assert all(ft.stem(r.w) == r.s for r in got)


def test_slices_hold_whole_documents(monkeypatch):
    monkeypatch.setattr(ft, "AT_ONCE", 10)
    assert list(ft._slices(np.array([4, 6, 1, 0, 25, 0, 3]))) == [(0, 2), (2, 4), (4, 5), (5, 7)]
    assert list(ft._slices(np.array([], int))) == []


def test_rows_of_one_id_are_one_document(spark):
    rows = [(None, "le rouge"), (None, "rouges"), (1, "vert rouge"), (1, "verts"), (2, None), (3, "de la"), (4, "")]
    got = {(r.term, r.doc_id): r.places for r in ft.postings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == {("roug", None): [1, 2], ("vert", 1): [1, 1], ("roug", 1): [2]}
    empty = ft._by_terms(pa.array([1], pa.int64()), pa.array([[[]]], pa.list_(pa.list_(pa.string()))))
    assert empty.num_rows == 0
