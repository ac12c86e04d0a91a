import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quaywise.operators import retrieval
from quaywise.operators import vector_index as vi
from quaywise.session import read

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def grouped(n, groups, dim=16, seed=1):
    """Vectors in narrow groups."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return [(i, (middle[i % groups] + rng.normal(size=dim) * 0.15).tolist()) for i in range(n)]


def asked(vectors):
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id) for r in df.collect())


def test_recall_on_the_given_vectors(spark):
    vectors = read(spark, "/root/testdata/sf0.01", "embeddings")
    cells = vi.fitted(vectors)
    found = vi.search(vi.indexed(vectors, cells), vi.probed(asked(vectors), cells), 10)
    assert vi.recall(found, retrieval.dense_topk(vectors, asked(vectors), 10)).first().recall >= 0.9


def test_few_cells_do_where_vectors_lie_in_groups(spark):
    vectors = spark.createDataFrame(grouped(1500, 30), SCHEMA)
    cells = vi.fitted(vectors, recall=0.95)
    assert len(cells.centroids) == 39 and cells.probes <= 4
    found = vi.search(vi.indexed(vectors, cells), vi.probed(asked(vectors), cells), 10)
    assert vi.recall(found, retrieval.dense_topk(vectors, asked(vectors), 10)).first().recall >= 0.95


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
@pytest.mark.parametrize("block", [7, 8192])
def test_all_cells_give_the_exact_search(spark, metric, block):
    some = grouped(300, 6, seed=2)
    some += [(1000 + i, some[0][1]) for i in range(60)]  # copies
    vectors = spark.createDataFrame(some, SCHEMA)
    cells = vi.fitted(vectors, cells=9)
    cells = vi.Cells(cells.centroids, 9)
    found = vi.search(vi.indexed(vectors, cells), vi.probed(asked(vectors), cells), 5, metric, block)
    assert rows(found) == rows(retrieval.dense_topk(vectors, asked(vectors), 5, metric))


def test_cells_and_probes_are_those_of_plain_python(spark):
    some = grouped(200, 5, dim=4, seed=3)
    vectors = spark.createDataFrame(some, SCHEMA).repartition(3)
    cells = vi.fitted(vectors, cells=7, rounds=2)

    def pointed(v):
        most = max(map(abs, v))
        whole = [math.floor(x / most * 32767.0) for x in v]
        return [math.floor(vi.UNIT * x / math.sqrt(sum(y * y for y in whole))) for x in whole]

    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    of = {r.vec_id: r.cell for r in vi.indexed(vectors, cells).collect()}
    near = {}
    for r in vi.probed(asked(vectors), vi.Cells(cells.centroids, 3)).collect():
        near.setdefault(r.query_id, []).append(r.cell)
    for i, v in some:
        order = sorted(range(7), key=lambda c: (far(pointed(v), cells.centroids[c]), c))
        assert of[i] == order[0] and (i % 20 or near[i] == order[:3])


def test_vectors_without_a_direction_are_never_found(spark):
    some = grouped(100, 3, dim=4)
    bad = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (205, [float("inf"), 0.0, 0.0, 0.0]), (206, [1.0, 2.0]), (None, some[0][1])]
    vectors = spark.createDataFrame(some + bad, SCHEMA)
    cells = vi.fitted(vectors, cells=3)
    kept = {r.vec_id for r in vi.indexed(vectors, cells).collect()}
    assert kept == {i for i, _ in some} | {None}
    nothing = vi.fitted(vectors.where("1 = 0"))
    assert vi.search(vi.indexed(vectors, nothing), vi.probed(asked(vectors), nothing), 3).collect() == []
    with pytest.raises(ValueError):
        vi.search(vectors, vectors, 0)


def test_a_stored_index_is_read_by_cell_and_grows(spark, tmp_path):
    some = grouped(400, 8, seed=5)
    random.Random(1).shuffle(some)
    vectors = spark.createDataFrame(some, SCHEMA)
    old, new = vectors.where("vec_id < 300"), vectors.where("vec_id >= 300")
    cells = vi.fitted(vectors, cells=8)
    path = str(tmp_path / "index")
    vi.saved(vi.indexed(old, cells), path)
    vi.saved(vi.indexed(new, cells), path, "append")
    index = vi.opened(spark, path)
    want = vi.search(vi.indexed(vectors, cells), vi.probed(asked(vectors), cells), 4)
    assert rows(vi.search(index, vi.probed(asked(vectors), cells), 4)) == rows(want)
    one = index.where("cell = 3")
    assert all("cell=3" in f for f in one.inputFiles()) or "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().toString()
