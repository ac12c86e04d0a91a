"""The pipeline's SimHash near-dedup: ball hashing, completed by banded MinHash, every link checked by exact Jaccard similarity.

Texts have A-Z lower-cased and are cut into words of anything but ASCII white space; the shingles of a text are the set
of its runs of five words (the whole sequence where there are fewer), each as a 64-bit hash. Texts of equal sets are one
class, which is what is compared; texts without words are a class of their own that is like no other. A very long text
is hashed whole.

Candidates come in two ways. The SimHash of each set goes through the ball hashing of `simhash.links`: fingerprints
within two bits meet on a common variant. That finds what differs by a few shingles, but of pairs at a similarity of
0.8, whose fingerprints are some ten bits apart, only about 1 in 500, and a ball that holds ten bits has too many
variants to emit. So two classes are candidates as well if a band of ROWS least hashes is equal in both; of BANDS bands,
a pair of similarity s has none in common with a chance of (1 - s^ROWS)^BANDS: 1 in 9000 at 0.8, 1 in 2 million at 0.9.

Each candidate is verified by its exact similarity before it counts as a link. The members of a bucket (the classes that
share a band) are first compared with its smallest one. Where that doesn't connect all the others, every two of those
are compared as well, by the product of their incidence matrices, large buckets in parts; a part gives no more links
than connect its members. So a group whose members are all near copies of one costs a comparison a member, a loose one
the square of its bucket, and no candidate that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaywise.llm import simhash, textkit
from quaywise.llm.components import components
from quaywise.llm.tables import cut, free, quoted, text_of

WIDTH, ROWS, BANDS = 5, 6, 30
#: The least similarity of near copies as a fraction.
LEAST = (4, 5)
#: Members of a larger bucket are dealt into parts of about so many, and each two parts are compared in one group.
CHUNK = 400

_SEEDS = textkit.mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _TIMES = _SEEDS[: ROWS * BANDS, None], _SEEDS[ROWS * BANDS :, None] | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the shingles of one text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)
    words = textkit.word_hashes(data, *textkit.word_spans(data))
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = textkit.mix(h * _STEP + words[i : i + n])
    return np.unique(h)


def bands(some: np.ndarray) -> np.ndarray:
    """The hash of each band of least hashes of a set that isn't empty."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(some), 512):
        np.minimum(least, ((some[at : at + 512] ^ _XOR) * _TIMES).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = textkit.mix(out * _STEP + row)
    return out


def set_hash(some: np.ndarray) -> int:
    """A 64-bit hash of a set as a signed long; 0 for the empty one."""
    if not len(some):
        return 0
    with np.errstate(over="ignore"):
        both = np.array([textkit.mix(some * _STEP).sum(dtype=np.uint64) + np.uint64(len(some))], dtype=np.uint64)
    return int(textkit.mix(both).view(np.int64)[0])


def fingerprint(some: np.ndarray) -> int:
    """The SimHash of a set of hashes as a signed long: bits that more than half of them have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(some), 65536):
        ones += np.unpackbits(some[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(some), bitorder="little").view("<i8")[0])


SIGNED = T.StructType([T.StructField("c", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.arrow_udf(SIGNED)
def _signed(text: pa.Array) -> pa.Array:
    c, n, fps, keys = [], [], [], []
    for some in textkit.sliced(text):
        for t in some:
            s = shingles(t)
            c.append(set_hash(s))
            n.append(len(s))
            fps.append(fingerprint(s))
            keys.append(bands(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
    ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
    names = ["c", "n", "fp", "bands"]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(fps, pa.int64()), lists], names=names)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _sets(text: pa.Array) -> pa.Array:
    return pa.array([shingles(t).view(np.int64) for some in textkit.sliced(text) for t in some], pa.list_(pa.int64()))


def _alike(both, a, b):
    """Whether sets of a and b elements, `both` of them in common, are near copies: for columns and for numpy arrays."""
    over, under = LEAST
    return both * under >= (a + b - both) * over


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those that are near copies."""
    one = sets.select(F.col("c").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("c").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(one, "a").join(two, "b").where(_alike(both, F.size("sa"), F.size("sb"))).select("a", "b")


def _linked(members: pa.Table) -> pa.Table:
    """All links between members (c, root, set) of a bucket, or of two parts of one, that have different roots."""
    c, root = (members.column(k).to_numpy() for k in ("c", "root"))
    sets = members.column("set").combine_chunks()
    sizes = np.diff(sets.offsets.to_numpy())
    _, column, often = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(c)), sizes)
    shared = often[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, order = owner[shared], np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(c), len(c)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        p, q = np.searchsorted(column, (at, at + 4096))
        has = np.zeros((len(c), int(column[q - 1]) - at + 1), dtype=np.float32)
        has[owner[p:q], column[p:q] - at] = 1
        both += has @ has.T
    a, b = np.nonzero(_alike(both.astype(np.int64), sizes[:, None], sizes[None, :]) & (root[:, None] != root[None, :]) & (c[:, None] < c[None, :]))
    return pa.table({"a": c[a], "b": c[b]})


def _connecting(members: pa.Table) -> pa.Table:
    """Of the links that _linked finds, as many as connect the same roots: one less than there are members, at most."""
    found = _linked(members)
    root = dict(zip(*(members.column(k).to_pylist() for k in ("c", "root")), strict=True))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    some = []
    for i, (a, b) in enumerate(zip(*(found.column(k).to_pylist() for k in ("a", "b")), strict=True)):
        a, b = top(root[a]), top(root[b])
        if a != b:
            up[a] = b
            some.append(i)
    return found.take(pa.array(some, pa.int64()))


def _possible(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, with sizes na, nb) whose sizes alone allow them to be near copies."""
    return pairs.where(_alike(F.least("na", "nb").cast("long"), F.col("na"), F.col("nb"))).select("a", "b").distinct()


def ball_candidates(classes: DataFrame) -> DataFrame:
    """Pairs (a, b, with sizes na, nb) of classes (c, n, fp) that the ball hashing of their fingerprints brings together.

    All classes of one fingerprint meet its smallest one, and the smallest ones of two linked fingerprints each other.
    """
    some = classes.where("n > 0").select("c", "n", "fp")
    first = cut(some.groupBy("fp").agg(F.min(F.struct("c", "n")).alias("h")))
    same = some.join(first, "fp").where("c <> h.c").select(F.col("h.c").alias("a"), F.col("c").alias("b"), F.col("h.n").alias("na"), F.col("n").alias("nb"))
    met = simhash.links(first.select("fp"))
    one, two = first.select(F.col("fp").alias("a"), F.col("h").alias("x")), first.select(F.col("fp").alias("b"), F.col("h").alias("y"))
    met = met.join(one, "a").join(two, "b").select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
    return same.union(met)


def links(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Verified links (a, b) between classes (c, n, fp, bands) that connect whatever candidates are near copies.

    sets_of(c) gives (c, set) for a table of classes.
    """
    held = classes.select("c", "n", F.explode("bands").alias("key"))
    hubs = held.groupBy("key").agg(F.min(F.struct("c", "n")).alias("hub"), F.count("*").alias("_of")).where("_of > 1").select("key", "hub")
    buckets = cut(held.join(hubs, "key"))
    star = buckets.where("c <> hub.c").select(F.col("hub.c").alias("a"), F.col("c").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb"))
    pairs = cut(_possible(star.union(ball_candidates(classes))))
    sets = cut(sets_of(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(buckets.select("c")).distinct()))
    found = cut(_verified(pairs, sets))
    roots = components(found)
    at = buckets.where("c <> hub.c").join(roots, buckets.c == roots.node, "left").select("key", "c", F.coalesce("root", "c").alias("root"))
    split = at.groupBy("key").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.count("*").alias("_of")).where("_a <> _b")
    parts = F.ceil(F.col("_of") / CHUNK)
    rest = at.join(split, "key").withColumns({"parts": parts, "x": F.pmod(F.xxhash64("c"), parts)})
    rest = rest.select("key", "c", "root", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"))
    rest = rest.select("key", "c", "root", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).join(sets, "c")
    return found.union(rest.groupBy("key", "i", "j").applyInArrow(_connecting, "a long, b long")).distinct()


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each component of near copies: that of the smallest id (nulls last), of one id that of the least text hash.

    Ids, set hashes, fingerprints and bands are what is shuffled to choose; texts are shuffled to find those that have a
    candidate, and the chosen rows. Rows equal in id and text can't be told apart; one of them stays. Other columns keep
    their values, whatever their names.
    """
    key, number = free(docs, "_key", "_number")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("k"), F.xxhash64(F.col("doc_id").isNull(), text_of()).alias("h"))
    slim = docs.select(place.alias("place"), text_of().alias("text"))
    rows = slim.select("place", _signed(F.col("text")).alias("s"))
    classes = cut(rows.groupBy(F.col("s.c").alias("c")).agg(F.min("place").alias("first"), F.first("s.n").alias("n"), F.first("s.fp").alias("fp"), F.first("s.bands").alias("bands")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        places = classes.join(wanted, "c").select("c", F.col("first").alias("place"))
        return slim.join(places, "place").groupBy("c").agg(F.min("text").alias("text")).select("c", _sets(F.col("text")).alias("set"))

    roots = components(links(classes, sets_of))
    member = classes.join(roots, classes.c == roots.node, "left").select("first", F.coalesce("root", "c").alias("root"))
    chosen = member.groupBy("root").agg(F.min("first").alias(key)).select(key).distinct()
    kept = docs.withColumn(key, place).join(chosen, key, "left_semi")
    once = F.row_number().over(W.partitionBy(key).orderBy(key))
    return kept.withColumn(number, once).where(F.col(number) == 1).select(*map(quoted, docs.columns))
