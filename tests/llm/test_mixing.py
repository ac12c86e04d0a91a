import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import odd
from quaywise.llm import mixing
from quaywise.llm import queries


def plain_targets(sizes, weights=(5, 2, 1)):
    """Reshares the excess again and again, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), Fraction(3, 2) * sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = Fraction(2 * sizes[s])
        left -= sum(out[s] for s in over)
        free -= over
    return out


def plain(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    target = plain_targets(sizes)
    run, out = defaultdict(int), []
    for i, s, n in sorted(sized, key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], r[0] is not None, r[0] or 0, r[2])):
        whole = int(target[s] >= sizes[s])
        copies = whole + int(run[s] + Fraction(n, 2) <= target[s] - whole * sizes[s])
        run[s] += n
        out.append((i, n, sizes[s], round(float(target[s]), 6), copies * n))
    return sorted(out, key=repr), target


def rounded(df):
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    assert rounded(mixing.mixture(odd.docs(spark))) == plain([(r[0], r[1], r[3]) for r in odd.rows()])[0]
    assert mixing.mixture(odd.empty(spark)).collect() == []


def test_sources_of_all_sizes(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["s0"] * 8 + [f"s{k}" for k in range(7)] + [None, "É", "z"])) for i in range(3000)]
    want, target = plain(rows)
    got = rounded(mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)))
    assert got == want
    by = defaultdict(int)
    for i, _, _, _, taken in got:
        by[rows[i][2]] += taken
    assert all(abs(by[s] - target[s]) <= 30 for s in target) and all(t <= 2 * n for _, n, _, _, t in got)


def test_all_texts_empty(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert rounded(mixing.mixture(df)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_thresholds_are_used_without_a_broadcast_too(spark, monkeypatch):
    want = rounded(mixing.mixture(odd.docs(spark)))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert rounded(mixing.mixture(odd.docs(spark))) == want


def test_no_python_in_the_plan(spark):
    plan = mixing.mixture(odd.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "op3_mixing" in queries.ORACLES
