import hashlib
import random
import re
import struct

import odd
import pytest
import xxhash
from pyspark.sql import functions as F
from quaywise.llm import minhash as m

M64 = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values, seed=42):
    h = seed
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", signed(v)), h)
    return h


def plain_fingerprint(text):
    hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [chained(hs[i : i + 5]) for i in range(len(hs) - 4)] or ([chained(hs)] if hs else [])
    least = {}
    for h in shingles:
        j = ((h >> 56) + 128) % 256  # bins in the order of signed hashes
        least[j] = min(least.get(j, h), h)
    if not least:
        return [0] * 256
    out = []
    for j in range(256):
        v = least.get(j)
        for a, b in m.TRIES:
            if v is None:
                v = least.get((j * a + b & 0xFFFFFFFF) >> 24)
        if v is None:
            def order(y, j=j):
                h = xxhash.xxh64_intdigest(struct.pack("<i", j), 42)
                return signed(xxhash.xxh64_intdigest(struct.pack("<q", y >> 56), h))

            v = min(least.values(), key=lambda y: (order(y), signed(y)))
        out.append(v & 255)
    return out


def plain_rows(rows):
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain_fingerprint(text), plain_fingerprint(edited), plain_fingerprint(after)
        like = lambda x, y: max(0.0, (sum(p == q for p, q in zip(x, y, strict=True)) / 256 - 1 / 256) / (1 - 1 / 256))
        yield i, len(text), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), round(like(a, b), 9), round(like(a, c), 9)


@pytest.mark.parametrize("per_bucket", [3, 1000])
def test_matches_brute_force(spark, monkeypatch, per_bucket):
    rows = list({r[0]: r[:2] for r in odd.rows() if r[0] is not None}.values())
    rows += [(100 + 7 * i, " ".join(odd.words(50 + i, 3 * i))) for i in range(12)]
    whole = m.with_next
    monkeypatch.setattr(m, "with_next", lambda d, c: whole(d, c, rows_per_bucket=per_bucket))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in m.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(plain_rows(rows))


def test_odd_rows(spark):
    got = m.fingerprints(odd.docs(spark)).collect()
    assert len(got) == len(odd.rows())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 512 for r in got)
    by_text = {}
    for r in spark.createDataFrame(odd.docs(spark).collect(), odd.SCHEMA).select("text", m.as_hex(m.packed(F.coalesce("text", F.lit("")))).alias("f")).collect():
        assert by_text.setdefault(r.text or "", r.f) == r.f
    assert m.fingerprints(odd.empty(spark)).collect() == []


def test_likeness_is_near_the_jaccard_similarity(spark):
    rng, base = random.Random(2), odd.words(9, 2000, of=10**6)
    for kept in (1900, 1500, 1000):
        other = base[:kept] + odd.words(rng.randrange(10**6), 2000 - kept, of=10**6)
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, other))
        df = spark.createDataFrame([(" ".join(base), " ".join(other))], "a string, b string")
        got = df.select(m.likeness(m.packed(F.col("a")), m.packed(F.col("b")))).first()[0]
        assert abs(got - len(a & b) / len(a | b)) < 0.12


def test_no_python_in_the_plan(spark):
    plan = m.fingerprints(odd.docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("outer", "inner", "per_bucket"), [(3, 4, 5), (64, 64, 1), (2, 1024, 7)])
def test_next_row_over_two_levels_of_buckets(spark, monkeypatch, outer, inner, per_bucket):
    monkeypatch.setattr(m, "OUTER", outer)
    monkeypatch.setattr(m, "INNER", inner)
    rng = random.Random(outer)
    ids = [rng.randrange(-(10**15), 10**15) for _ in range(60)] + [5, 5, 5, 7, 7, -(1 << 63), (1 << 63) - 1] + [None] * 3
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    got = {r.text: r.next_text for r in m.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), ["text"], per_bucket).collect()}
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
