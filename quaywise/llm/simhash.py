"""SimHash near-dedup by meet-in-the-middle ball hashing.

Texts have A-Z lower-cased and are cut into words of anything but ASCII white space; a shingle is three words joined by
a space (the whole sequence where there are fewer), repeats included. A bit of the 64-bit fingerprint is 1 if more than
half of the shingles' XXH64 hashes (seed 42) have it. A text without words, or a null one, has the fingerprint zero.

Two fingerprints within `radius` bits have a common variant within half of it of each. So each *distinct* fingerprint
emits all variants within half the radius (65 for two bits), those that share a variant meet, and each meeting is
checked by counting the differing bits. As fingerprints are distinct, no more than the number of variants can meet on
one variant, whatever the size of the groups of copies: all copies of a text are one fingerprint. The members of a
meeting are linked to its smallest member; for an even radius all of them lie within the radius of each other, so this
loses no link for the components.

Null ids take part like others but can't name a component; a component with null ids only has a null component_id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaywise.llm import textkit
from quaywise.llm.components import components
from quaywise.llm.tables import cut, text_of

SEED, WIDTH = 42, 3


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The unsigned SimHash of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joint = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    first, last = begins[:n].tolist(), ends[-n:].tolist()
    h = np.array([digest(joint[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for some in textkit.sliced(text) for t in some], dtype=np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""
    return docs.withColumn(name, _fingerprints(text_of(text)))


def masks(bits: int) -> list[int]:
    """All 64-bit masks with at most so many ones, as signed longs."""
    out = [sum(1 << b for b in some) for k in range(bits + 1) for some in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Checked links (a, b) between distinct fingerprints (column fp) of at most `radius` differing bits."""
    if radius % 2:
        raise ValueError("the radius must be even")
    variants = fingerprints.select("fp", F.explode(F.array(*[F.lit(m) for m in masks(radius // 2)])).alias("m"))
    met = variants.select(F.expr("fp ^ m").alias("variant"), "fp")
    least = W.partitionBy("variant").orderBy("fp").rowsBetween(W.unboundedPreceding, 0)
    pairs = met.select("fp", F.first("fp").over(least).alias("least")).where("fp <> least")
    return pairs.select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct().where(F.bit_count(F.expr("a ^ b")) <= radius)


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """classes (fp and `first`, one row a distinct fingerprint) with the least `first` of the component as `least`."""
    roots = components(links(classes.select("fp"), radius))
    member = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return member.join(member.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "least")


def near_duplicates(docs: DataFrame, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id that links reach) for every row of docs."""
    rows = cut(with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id", F.col("_fp").alias("fp")))
    named = _rooted(cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"))), radius)
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def representatives(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of docs for each component: that of the smallest id (nulls last), of one id that of the least text hash.

    Ids, fingerprints and text hashes are what is shuffled to choose; texts are shuffled once, to find the chosen rows.
    Rows equal in id and text can't be told apart; one of them stays.
    """
    key = {"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), "_h": F.xxhash64(F.col("doc_id").isNull(), text_of())}
    rows = with_fingerprint(docs.select("doc_id", "text")).withColumns(key)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("_k").alias("k"), F.col("_h").alias("h"))
    classes = cut(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min(first).alias("first")))
    chosen = _rooted(classes, radius).select(F.col("least.k").alias("_k"), F.col("least.h").alias("_h")).distinct()
    kept = docs.withColumns(key).join(chosen, ["_k", "_h"], "left_semi")
    once = F.row_number().over(W.partitionBy("_k", "_h").orderBy("_k"))
    return kept.withColumn("_n", once).where("_n = 1").select(docs.columns)
