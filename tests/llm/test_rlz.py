import hashlib
import random
import re

import odd
import pytest
from quaywise.llm import rlz


def plain(rows, window):
    """Every window of every document in the order of ids; a word goes if a window that was seen before covers it."""
    seen, out = set(), []
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    shared = [odd.words(1000 + k, rng.randrange(15, 70)) for k in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts += rng.choice(shared) if rng.random() < 0.5 else odd.words(rng.randrange(10**6), rng.randrange(1, 40))
            if rng.random() < 0.1:
                parts += ["same"] * rng.randrange(10, 60)
        out.append((i * 3, rng.choice([" ", "\n", "\t "]).join(parts)))
    return out


@pytest.mark.parametrize(("window", "block_bytes", "n"), [(20, 3000, 150), (20, 10**9, 150), (5, 2000, 60), (33, 2500, 150), (8, 500, 40), (1, 800, 30)])
def test_matches_brute_force(spark, window, block_bytes, n):
    rows = corpus(window, n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert odd.got(rlz.removal(df, window=window, block_bytes=block_bytes)) == sorted(plain(rows, window), key=repr)


def mirrored(n):
    """Two words of n letters (a power of two) that every polynomial of their letters modulo 2^64 confuses."""
    odd_ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in odd_ones), "".join("ba"[x] for x in odd_ones)


@pytest.mark.parametrize("block_bytes", [100, 10**9])
@pytest.mark.parametrize("n", [64, 256, 4096, 16384])
def test_words_are_told_apart_by_their_letters(spark, n, block_bytes):
    rest = " ".join(odd.words(3, 19))
    a, b = mirrored(n)
    rows = [(i, f"{w} {rest}") for i, w in enumerate((a, b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in rlz.removal(df, block_bytes=block_bytes).collect()] == [0, 0]
    rows.append((2, f"x {b} {rest}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert odd.got(rlz.removal(df, block_bytes=block_bytes)) == sorted(plain(rows, 20), key=repr)


@pytest.mark.parametrize("block_bytes", [20_000, 10**9])
def test_words_of_thousands_of_letters(spark, block_bytes):
    rng = random.Random(9)
    long = ["".join(rng.choice("ab") for _ in range(10_000 + k)) for k in range(6)] + list(mirrored(8192))
    rows = [(i, " ".join(rng.choice(long if rng.random() < 0.3 else ["c", "d"]) for _ in range(60))) for i in range(12)]
    rows += [(20 + i, t) for i, t in rows[:3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert odd.got(rlz.removal(df, window=3, block_bytes=block_bytes)) == sorted(plain(rows, 3), key=repr)


def test_factors_point_at_earlier_equal_words(spark):
    rows = corpus(7, 120)
    words = {i: t.split() for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    factors = rlz.duplicate_spans(df, block_bytes=3000).collect()
    assert factors
    for f in factors:
        assert f.length >= 20 and (f.ref_doc, f.ref_start) < (f.doc_id, f.start)
        assert words[f.doc_id][f.start : f.start + f.length] == words[f.ref_doc][f.ref_start : f.ref_start + f.length]
    gone = {(f.doc_id, p) for f in factors for p in range(f.start, f.start + f.length)}
    assert len(gone) == sum(r.n_removed for r in rlz.removal(df, block_bytes=3000).collect())


@pytest.mark.parametrize("block_bytes", [400, 10**9])
def test_odd_rows(spark, block_bytes):
    rows = [r[:2] for r in odd.rows()]
    once = list({r[0]: r for r in rows if r[0] is not None and r[0] != 5}.values())
    assert odd.got(rlz.removal(odd.docs(spark, [(*r, *[None] * 7) for r in once]), block_bytes=block_bytes)) == sorted(plain(once, 20), key=repr)
    all_rows = rlz.removal(odd.docs(spark), block_bytes=block_bytes).collect()
    base = [r for r in all_rows if r.n_words == 120]
    assert len(all_rows) == len(rows) and sum(r.n_removed == 0 for r in base if r.doc_id != 8) == 1
    assert rlz.removal(odd.empty(spark)).collect() == []


def test_deduplicated_keeps_rows_and_columns(spark):
    df = odd.docs(spark)
    out = rlz.deduplicated(df, block_bytes=400)
    assert out.columns == df.columns and out.count() == df.count()
    assert all(r.n_chars == len(r.text) for r in out.collect())


def plain_factors(words, ref_words, window):
    """The greedy parse of one list of words against itself and one before it, by comparing words at every place."""
    text = ref_words + words
    first = {}
    for p in [*range(len(ref_words) - window + 1), *range(len(ref_words), len(text) - window + 1)]:
        first.setdefault(tuple(text[p : p + window]), p)
    out, p = [], len(ref_words)
    while p <= len(text) - window:
        r = first[tuple(text[p : p + window])]
        if r == p:
            p += 1
            continue
        n, limit = 0, len(ref_words) if r < len(ref_words) else len(text)
        while p + n < len(text) and r + n < limit and text[p + n] == text[r + n]:
            n += 1
        out.append((p - len(ref_words), n, 0 if r < len(ref_words) else 1, r if r < len(ref_words) else r - len(ref_words)))
        p += n - window + 1
    return out


def test_factors_are_those_of_a_greedy_parse(spark):
    rng = random.Random(11)
    for k in range(4):
        base = odd.words(k, 300)
        text = []
        while len(text) < 400:
            a = rng.randrange(len(base) - 60)
            text += base[a : a + rng.randrange(5, 60)] + odd.words(rng.randrange(10**6), rng.randrange(3))
        df = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(text))], "doc_id long, text string").coalesce(1)
        got = sorted((f.start, f.length, f.ref_doc, f.ref_start) for f in rlz.duplicate_spans(df).collect() if f.doc_id == 1)
        assert got == plain_factors(text, base, 20)


def test_repeated_rows_are_spread_over_blocks(spark):
    row = (3, " ".join(odd.words(5, 200)))
    df = spark.createDataFrame([row] * 40, "doc_id long, text string").repartition(8)
    out = rlz.removal(df, block_bytes=3000).collect()
    assert sorted(r.n_removed for r in out) == [0] + [200] * 39
