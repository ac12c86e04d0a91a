import random
from collections import Counter

import corpus_pipeline as pipe
import numpy as np
import odd
import pytest
from pyspark.sql import functions as F
from quaywise.llm import jaccard
from quaywise.llm.tables import table


def plain_set(text):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    return frozenset(" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)) or frozenset([" ".join(ws)] if ws else [])


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def plain_near(rows):
    """Of each component of texts (id, text) with a Jaccard similarity of 0.8 or more, by all pairs, the smallest id."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and alike(a, b):
                root[find(i)] = find(j)
    best = {}
    for k, (i, _) in enumerate(rows):
        best[find(k)] = min(i, best.get(find(k), i))
    return sorted(best.values())


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in pipe.drop_near_duplicates(spark, docs, "").collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_documents_match_brute_force(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_near(rows)
    assert len(want) < len({plain_set(t) for _, t in rows})  # some near copies that aren't exact ones
    assert sorted(r.doc_id for r in pipe.drop_near_duplicates(spark, docs, "").collect()) == want


def test_loose_group_and_edge_of_similarity_match_brute_force(spark, monkeypatch):
    rng, base, rows = random.Random(3), odd.words(7, 150), []
    for _ in range(90):
        some = list(base)
        for _ in range(rng.randrange(7)):
            some[rng.randrange(len(some))] = f"edit{rng.random()}"
        rows.append((len(rows), " ".join(some)))
    for n in (20, 45, 104):  # a tail of a quarter: exactly 0.8, and one shingle less
        some = [f"w{n}x{i}" for i in range(n)]
        more = (n - 4) // 4
        rows += [(len(rows) + k, " ".join(some + [f"t{k}{i}" for i in range(e)])) for k, e in enumerate((0, more, more + 1))]
    monkeypatch.setattr(jaccard, "CHUNK", 10)
    want = plain_near(rows)
    assert 10 < len(want) < 80
    assert kept(spark, rows) == want


def test_links_inside_a_bucket_match_all_pairs():
    import pyarrow as pa

    rng = random.Random(4)
    sets = [sorted(rng.sample(range(40), rng.randrange(25, 40))) for _ in range(60)]
    root = [i % 50 for i in range(60)]
    got = jaccard._linked(pa.table({"c": list(range(60)), "root": root, "set": pa.array(sets, pa.list_(pa.int64()))}))
    want = {(i, j) for j in range(60) for i in range(j) if root[i] != root[j] and alike(set(sets[i]), set(sets[j]))}
    assert want and set(zip(*(got.column(k).to_pylist() for k in "ab"), strict=True)) == want


def test_fewest_links_inside_a_bucket_connect_the_same():
    import pyarrow as pa

    def parts(n, links):
        part = list(range(n))
        for a, b in links:
            part = [part[a] if p == part[b] else p for p in part]
        return {frozenset(i for i in range(n) if part[i] == p) for p in part}

    rng = random.Random(4)
    near = [sorted(rng.sample(range(40), rng.randrange(25, 40))) for _ in range(60)]
    for sets in (near, [[1, 2, 3]] * 30, [[i] for i in range(30)], [[1]], []):
        n = len(sets)
        root = [i % 50 for i in range(n)]
        table = pa.table({"c": pa.array(range(n), pa.int64()), "root": pa.array(root, pa.int64()), "set": pa.array(sets, pa.list_(pa.int64()))})
        every, some = ([(root[a], root[b]) for a, b in zip(*(t.column(k).to_pylist() for k in "ab"), strict=True)] for t in (jaccard._linked(table), jaccard._connecting(table)))
        assert parts(50, some) == parts(50, every) and len(some) <= max(n - 1, 0)
        assert len(some) == 50 - len(parts(50, every))


def test_odd_rows(spark):
    out = jaccard.representatives(odd.docs(spark)).collect()
    assert sum(r.text in (None, "", " \t\n") for r in out) == 1
    assert Counter(r.doc_id for r in out)[5] == 2
    assert jaccard.representatives(odd.empty(spark)).collect() == []


def test_chance_of_a_common_band():
    rng, found = np.random.default_rng(5), 0
    for _ in range(400):
        h = rng.integers(0, 2**63, 120, dtype=np.uint64)
        a, b = h[:108], h[12:]  # 96 of 120: 0.8
        found += bool((jaccard.bands(a) == jaccard.bands(b)).any())
    assert found >= 398


def test_ids_and_columns(spark):
    text = " ".join(odd.words(9, 60))
    df = spark.createDataFrame([(None, text, 1), (7, text + " tail", 2), (3, text.upper(), 3)], "doc_id long, text string, x int")
    assert [tuple(r) for r in jaccard.representatives(df).collect()] == [(3, text.upper(), 3)]
    assert jaccard.representatives(df.where(F.col("doc_id").isNull())).count() == 1


def test_whole_run_drops_near_copies(spark):
    docs = table(spark, odd.DATA, "documents")
    good = [(r.doc_id, r.text) for r in pipe.keep_quality(spark, docs, odd.DATA).collect()]
    near = set(plain_near(good))
    assert {145, 177} <= {i for i, _ in good} - near  # near copies of 6 and 1 (0.83), 7 and 11 bits apart by SimHash
    assert {r.doc_id for r in pipe.run(spark, odd.DATA).select("doc_id").collect()} <= near
