"""Memory of Python workers in dense search: few similarities at a time, floats in the shuffle, one worker a task."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from quaywise.operators import retrieval, vector_index

SCHEMA = "vec_id long, embedding array<float>"


def vectors(spark, n=2100, dim=4):
    v = np.random.default_rng(1).normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], SCHEMA)


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_a_group_holds_a_few_megabytes(metric):
    v = np.random.default_rng(3).normal(size=(8192, 16)).astype(np.float32)
    frame = pd.DataFrame({"id": np.arange(8192), "v": list(v)})
    tracemalloc.start()
    found = retrieval.best_of(metric, 10)(frame, frame[:1024])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 10240 and peak < 16e6


def test_floats_are_shuffled_and_small_tables_dealt_into_blocks(spark):
    rows = vectors(spark)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieval.dense_topk(rows, asked, 3, "ip")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan
    assert rows.count() / 512 > 4 and "least(16" in plan.lower().replace("cast(", "")
    v = {r.vec_id: np.array(r.embedding, np.float64) for r in rows.collect()}
    for q, own in pd.DataFrame(found.collect(), columns=found.columns).groupby("query_id"):
        want = sorted(v, key=lambda i: (-float((v[i] * v[q]).sum()), i))[:3]
        assert own.sort_values("rank")["vec_id"].tolist() == want

def test_cells_are_computed_once(spark):
    rows = vectors(spark, 200)
    cells = vector_index.fitted(rows, cells=5)
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for df in (vector_index.indexed(rows, cells), vector_index.probed(asked, cells), rows.select(vector_index.direction("embedding").alias("u")).where("u is not null")):
        assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
