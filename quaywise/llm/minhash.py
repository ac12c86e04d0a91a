"""Document fingerprints by one-permutation MinHash with optimal densification, in DataFrame functions only.

A text's shingles are five words in a row (the whole sequence where there are fewer), words being runs of anything but
ASCII white space, repeats included. Each shingle is hashed once. The top bits of the hash choose one of BINS bins and
each bin keeps its least hash. An empty bin takes the value of another one: the first that isn't empty among a few
universal hashes of its number, and after these the one that comes first in an order that is random but fixed for the
bin, so that texts agree on it as often as their shingles do. Of each bin the low BITS bits are stored, packed into
64-bit words; likeness is the share of equal bins, corrected for equal bits by chance.

Null texts count as empty; texts without words have the fingerprint zero, equal to each other. A very long text is
fingerprinted whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.llm.tables import NOT_SPACE, text_of

WIDTH, BINS, BITS = 5, 256, 8
#: Rows of a bucket of neighbouring ids, about, and the most buckets of each of the two levels.
BUCKET_ROWS, OUTER, INNER = 3000, 1024, 1024
#: Multiplier and offset of the universal hashes that empty bins try in turn.
TRIES = tuple((2654435761 + 2 * 40503 * t * t + 2 * t, 97 + 1013904223 * t % 65521) for t in range(1, 9))
LOW = (1 << 56) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 56)


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """array<long> of the hashes of all shingles."""

    def of(h: Column) -> Column:
        n = F.size(h)
        every = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(width))))
        return F.when(n >= width, every).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return _let(F.transform(F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0)), lambda w: F.xxhash64(w)), of)


def _least(hashes: Column) -> Column:
    """The least hash of each bin, in the order of bins; where a bin is empty, a value with all low bits set."""
    marks = F.array(*[F.lit((b << 56 | LOW) - (1 << 64 if b >= 128 else 0)) for b in range(BINS)])
    ordered = F.array_sort(F.concat(hashes, marks))
    return _let(ordered, lambda s: F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1)))))


def _dense(least: Column) -> Column:
    """least with every empty bin filled from another one, unless all are empty."""
    full = lambda x: F.when(x.bitwiseAND(LOW) != LOW, x)

    def fill(m: Column, some: Column) -> Column:
        def one(x: Column, j: Column) -> Column:
            tries = [full(F.get(m, F.shiftright((j.cast("long") * a + b).bitwiseAND((1 << 32) - 1), 24).cast("int"))) for a, b in TRIES]
            last = F.array_min(F.transform(some, lambda y: F.struct(F.xxhash64(j, _bin(y)).alias("o"), y.alias("y"))))["y"]
            return F.coalesce(full(x), *tries, last, F.lit(0))

        return F.transform(m, one)

    return _let(least, lambda m: _let(F.filter(m, lambda x: x.bitwiseAND(LOW) != LOW), lambda some: fill(m, some)))


def packed(text: Column) -> Column:
    """The fingerprint of a text as array<long>."""
    per = 64 // BITS

    def pack(d: Column) -> Column:
        def word(k: Column) -> Column:
            parts = [F.shiftleft(F.get(d, k * per + i).bitwiseAND((1 << BITS) - 1), BITS * (per - 1 - i)) for i in range(per)]
            out = parts[0]
            for p in parts[1:]:
                out = out.bitwiseOR(p)
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), word)

    return _let(_dense(_least(shingle_hashes(text))), pack)


def as_hex(fp: Column) -> Column:
    return F.lower(F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles of two packed fingerprints, 0 to 1."""

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for by in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, by))
        return F.bit_count(z.bitwiseAND(0x0101010101010101))

    unlike = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), ((1 - unlike / F.lit(float(BINS))) - chance) / (1 - chance))


def _edges(ids: DataFrame, outer: int, inner: int, top: int) -> DataFrame:
    """One row: `outer`, the ids that begin all outer buckets but the first, in descending order; `inner`, the same of the inner ones of each.

    Edges are ids that exist, so every bucket has the row that it begins with. Both levels hold some OUTER and OUTER * INNER
    ids at most, whatever the input.
    """

    def cut(n: int) -> Column:
        return F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(max(10_000, 10 * n))) if n > 1 else F.array().cast("array<long>")

    def descending(edges: Column, first: Column) -> Column:
        return F.reverse(F.array_sort(F.array_except(edges, F.array(first))))

    first = ids.agg(descending(cut(outer), F.lit(top).cast("long")).alias("outer"))
    rows = ids.withColumn("_e", first.scalar()).select("doc_id", _above(F.col("_e"), F.col("doc_id")).alias("o")).groupBy("o").agg(cut(inner).alias("cuts"), F.max("doc_id").alias("first"))
    each = rows.select("o", descending(F.col("cuts"), F.col("first")).alias("edges"))
    lists = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "edges"))), lambda r: r["edges"]).alias("inner"))
    return lists.withColumn("outer", first.scalar())


def _above(edges: Column, x: Column) -> Column:
    """How many edges are at least x."""
    return F.size(F.filter(edges, lambda e: e >= x))


def with_next(docs: DataFrame, columns: list[str], rows_per_bucket: int = BUCKET_ROWS) -> DataFrame:
    """docs with next_<column>: its value in the next row by descending doc_id (null ids last), the first row's in the last.

    Rows are dealt into buckets of neighbouring ids, whose first ids also go, as ghosts, to the bucket before, so each
    row finds the next one in its own bucket and texts are shuffled once. Buckets hold about rows_per_bucket rows, or, of
    more than 3 thousand million documents, a millionth of all. Rows of one id follow each other by `columns`; null ids
    share the last bucket.
    """
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id")
    n, top = ids.agg(F.count("*"), F.max("doc_id")).first()
    buckets = -(-n // rows_per_bucket)
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    first = F.col("doc_id").eqNullSafe(F.lit(top).cast("long"))
    none = F.array().cast("array<struct<b:int,g:int>>")
    here = lambda b, g: F.array(F.struct(b.cast("int").alias("b"), F.lit(g).alias("g")))
    if buckets < 2:
        rows = docs.withColumn("_p", F.explode(F.concat(here(F.lit(0), 0), F.when(first, here(F.lit(0), 2)).otherwise(none))))
    else:
        outer = min(OUTER, buckets)
        edges = _edges(ids, outer, min(INNER, -(-buckets // outer)), top)
        e = edges.select(F.struct("outer", "inner")).scalar()
        rows = docs.withColumn("_e", e).withColumn("_o", _above(F.col("_e.outer"), key))
        rows = rows.withColumn("_l", F.get("_e.inner", F.col("_o"))).withColumn("_i", _above(F.col("_l"), key))
        o, i, count = F.col("_o"), F.col("_i"), lambda x: F.size(F.get("_e.inner", x))
        begins = F.when(i > 0, F.get("_l", i - 1)).otherwise(F.get("_e.outer", o - 1))
        before = F.when(i > 0, o * INNER + i - 1).otherwise((o - 1) * INNER + count(o - 1))
        last = F.size("_e.outer")
        places = F.concat(here(o * INNER + i, 0), F.when(F.col("doc_id") == begins, here(before, 1)).otherwise(none), F.when(first, here(last * INNER + count(last), 2)).otherwise(none))
        rows = rows.withColumn("_p", F.explode(places)).drop("_e", "_o", "_l", "_i")
    order = W.partitionBy("_p.b").orderBy("_p.g", F.col("doc_id").desc_nulls_last(), *columns)
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return rows.where("_p.g = 0").drop("_p")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprints of the text and of its edited text, and their likenesses, for every row of docs.

    The edited text has the last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next
    document by descending doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = with_next(rows.withColumn("fp", packed(F.col("text"))), ["text", "fp"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select("doc_id", n.alias("n_chars"), "fp", "next_fp", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edited_fp", packed(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
