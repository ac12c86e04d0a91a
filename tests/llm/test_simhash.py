import random

import odd
import pytest
import xxhash
from pyspark.sql import functions as F
from quaywise.llm import components, simhash


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    """Component of each distinct fingerprint by comparing all pairs."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    return sorted(((i, f"{f:016x}", least.get(roots[f])) for (i, _), f in zip(rows, fps, strict=True)), key=repr)


def test_fingerprints_equal_the_jvm_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)
    for text in ("", "One", "A b\tC\x0bd É", " ".join(odd.words(3, 500))):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_odd_rows_match_brute_force(spark):
    rows = [r[:2] for r in odd.rows()]
    assert odd.got(simhash.near_duplicates(odd.docs(spark))) == expected(rows)


def test_near_copies_match_brute_force(spark):
    rng, rows = random.Random(5), []
    for k in range(12):
        base = odd.words(100 + k, 260)
        for c in range(8):
            some = list(base)
            for _ in range(c % 4):
                some[rng.randrange(len(some))] = f"edit{rng.random()}"
            rows.append((len(rows), " ".join(some)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert len({c for _, _, c in want}) < len(rows)
    assert odd.got(simhash.near_duplicates(df)) == want


@pytest.mark.parametrize("radius", [2, 4])
def test_links_of_random_balls(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for c in centres for _ in range(25 if radius == 2 else 8)}
    fps |= {0, 1, 2**63, 2**64 - 1, 2**63 + 1}
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    pairs = [(a % 2**64, b % 2**64) for a, b in simhash.links(signed, radius).collect()]
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in pairs)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in pairs:
        root[find(a)] = find(b)
    want = plain_components(fps, radius)
    assert len({(find(f), want[f]) for f in fps}) == len({find(f) for f in fps}) == len(set(want.values()))


def test_no_rows(spark):
    assert simhash.near_duplicates(odd.empty(spark)).collect() == []


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = dict(components.components(edges).collect())
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
