import hashlib
import math
import random

import duckdb
import numpy as np
import odd
import pytest
from quaywise.llm import clusters
from quaywise.llm.queries import ORACLES
from quaywise.llm.tables import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, dim=64, k=8, rounds=10, scale=1024):
    """Python integers: every distance anew in each round."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centre = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centre))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centre)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == n]
            if own:
                centre[n] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [near(v) for _, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(
        [(i, n, d, sum(x for x, m in last if m == n), sum(x for x, _ in last), digest[n], sum(m == n for _, m in last)) for (i, _), (d, n) in zip(kept, last, strict=True)],
        key=repr,
    )


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_matches_sql_and_brute_force(spark):
    df = table(spark, odd.DATA, "embeddings")
    out = clusters.clusters(df)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{odd.DATA}/embeddings.parquet'")
    sql = con.sql(ORACLES["op12_clusters"])
    assert sql.columns == out.columns
    rows = got(out)
    assert rows == sorted(sql.fetchall(), key=repr) == plain([(r.vec_id, r.embedding) for r in df.collect()])


def odd_vectors(seed, dim=64):
    rng = random.Random(seed)
    base = [[rng.choice([-1.5, -0.25, 0.0, 0.1, 3.0]) for _ in range(dim)] for _ in range(5)]
    rows = [(i % 37, [x + rng.choice([0.0, 0.0, 0.01]) for x in base[i % 5]]) for i in range(120)]
    rows += [(7, base[0])] * 30 + [(None, base[1]), (None, base[2]), (200, None), (201, []), (202, base[0][:-1]), (203, [*base[0], 0.0])]
    for k, bad in enumerate([None, float("nan"), float("inf"), float("-inf")]):
        rows.append((300 + k, [*base[0][:-1], bad]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ties_repeats_nulls_and_bad_vectors(spark, seed):
    rows = odd_vectors(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    want = plain(rows)
    assert got(clusters.clusters(df.repartition(5))) == want == got(clusters.clusters(df.coalesce(1)))


def test_few_none_and_other_parameters(spark):
    few = odd_vectors(3)[:5]
    assert got(clusters.clusters(spark.createDataFrame([(*r, 0) for r in few], SCHEMA))) == plain(few)
    assert clusters.clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, [math.sin(i * j + j) for j in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    for rounds in (0, 1, 4):
        out = clusters.clusters(df, column="v", dim=3, k=5, rounds=rounds, scale=100)
        assert [r[:4] for r in got(out)] == [r[:4] for r in plain_double(rows, rounds)]


def plain_double(rows, rounds):
    keep, np.float32 = np.float32, np.float64
    try:
        return plain(rows, dim=3, k=5, rounds=rounds, scale=100)
    finally:
        np.float32 = keep


def test_products_are_mended_exactly(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-3000, 3000, (50, 6)).astype(np.int32)
    a, b = rng.integers(-3000, 3000, (2, 4, 6)).astype(np.int64)
    b[1], b[2, :5] = a[1], a[2, :5]
    rows = [(i, x.tolist(), int((x.astype(int) ** 2).sum()), (a @ x).tolist()) for i, x in enumerate(v)]
    state = spark.createDataFrame(rows, "vec_id long, v array<int>, norm long, dots array<long>")
    for r in clusters.mended(state, a, b).collect():
        far = ((b - v[r.vec_id]) ** 2).sum(axis=1)
        assert r.dots == (b @ v[r.vec_id]).tolist() and r.cluster == far.argmin() and r.distance == far.min()
