"""Dense and lexical search in bounded pieces, against plain versions."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from quaywise.operators import retrieval


def frame(v, first=0):
    return pd.DataFrame({"id": np.arange(first, first + len(v)), "v": list(v)})


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_group_of_vectors_holds_few_similarities(metric):
    v = np.random.default_rng(3).normal(size=(4096, 16))
    vs, qs = frame(v), frame(v[:2048])
    tracemalloc.start()
    found = retrieval.best_of(metric, 10)(vs, qs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 20480 and peak < 60e6  # all similarities at a time are 67 MB, their order as much


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_copies_ties_and_odd_vectors(metric):
    g = np.random.default_rng(5)
    v = np.round(g.normal(size=(300, 3)), 1)
    v[40:200] = v[7]
    v[210], v[211], v[212] = 0.0, np.nan, v[7] + 1e-13
    q = np.concatenate([v[[7, 3, 210]], v[7:8] * 2])
    found = retrieval.best_of(metric, 12)(frame(v), frame(q, 900))
    for i, x in enumerate(q):
        sims = {"l2": -np.sqrt(((v - x) ** 2).sum(axis=1)), "ip": (v * x).sum(axis=1)}
        with np.errstate(invalid="ignore"):
            sims["cosine"] = sims["ip"] / (np.sqrt((x * x).sum()) * np.sqrt((v * v).sum(axis=1)))
        want = [n for n in np.argsort(-sims[metric], kind="stable") if not np.isnan(sims[metric][n])][:12]
        got = found[found["query_id"] == 900 + i]
        assert got["vec_id"].tolist() == want and np.array_equal(got["similarity"], sims[metric][want])


def test_blocks_of_any_size_find_the_same(spark):
    v = np.random.default_rng(7).normal(size=(120, 8))
    v[30:60] = v[2]
    vectors = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as query")
    rows = lambda block: sorted(tuple(r) for r in retrieval.dense_topk(vectors, asked, 7, block=block).collect())
    assert len(rows(16)) == 42 and rows(16) == rows(16384)


def test_lexical_ranking_in_small_blocks(spark, monkeypatch):
    g = random.Random(11)
    texts = [" ".join(g.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(g.randint(0, 12))) for _ in range(70)]
    texts[40:60] = [texts[4]] * 20
    asked = ["alpha beta", "Zeta zeta unknown", "", "eta theta gamma delta", *["beta"] * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_text string")
    counts = [Counter(re.findall("[a-z0-9]{2,}", t.lower())) for t in texts]
    full = [sum(c.values()) for c in counts if c]
    want = set()
    for q, text in enumerate(asked):
        scores = {}
        for t in set(re.findall("[a-z0-9]{2,}", text.lower())):
            df = sum(t in c for c in counts)
            for d, c in enumerate(counts):
                if t in c:
                    scores[d] = scores.get(d, 0.0) + math.log(1 + (len(full) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) * len(full) / sum(full)))
        want |= {(q, d, i + 1) for i, d in enumerate(sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:5])}
    got = {(r.query_id, r.doc_id, r["rank"]) for r in retrieval.lexical_topk(docs, queries, 5, block=16).collect()}
    assert got == want
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "HELD", 4)  # slices of one document and of few queries
    hits = [(d, t, float(n)) for d, c in enumerate(counts) for t, n in c.items()]
    pairs = [(q, t) for q, text in enumerate(asked) for t in sorted(set(text.lower().split()))]
    table = lambda rows, names: pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    found = retrieval.best_texts(3)(table(hits, ["doc_id", "term", "weight"]), table(pairs, ["query_id", "term"])).to_pylist()
    sums = {q: sorted(((-sum(c[t] for t in set(text.lower().split())), d) for d, c in enumerate(counts)))[:3] for q, text in enumerate(asked)}
    assert sorted((r["query_id"], -r["score"], r["doc_id"]) for r in found) == sorted((q, s, d) for q, x in sums.items() for s, d in x if s < 0)
