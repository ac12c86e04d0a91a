"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and bucket of a hash of the id; from these histograms each source's budget finds the bucket
in which it is used up, that bucket alone is histogrammed again on the next bits of the hash, and what is left of the
boundary (one cell in 2**24 of a source) is settled in the order of the hash. Documents below the threshold are taken;
a source with a target above its size takes all documents once and those below the threshold twice, so that what is
taken for a smaller target is always part of what is taken for a larger one.

Null texts have size 0; null ids hash as the empty text; a null source is a source, the last in order. A document is
taken if the middle of its words lies within the budget, so a source's words miss the target by half a document at most.
Rows of one id and size are ordered by a hash of their texts; rows equal in all of these can't be told apart, and as many
of them are taken as fit. Documents of size 0 are taken 0 times. A very long text is counted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaywise.llm.tables import cut, free, quoted, NOT_SPACE

#: Bits of the hash that each of the two histograms looks at.
CELL_BITS = 12
#: Sources up to which the table of thresholds (under 100 bytes a row) is broadcast.
BROADCAST_ROWS = 20_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def id_hash(doc_id: str = "doc_id") -> Column:
    """60 bits of the MD5 of the id as text."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _place(h: Column, doc_id: Column, size: Column, text_hash: Column) -> Column:
    """The place of a row in the order of its source: by hash, id (null first), size, and the hash of the text where these tie."""
    return F.struct(h.alias("h"), doc_id.cast("long").alias("doc_id"), size.alias("size"), text_hash.alias("text"))


def _slim_place() -> Column:
    return _place(*map(F.col, ("h", "doc_id", "size", "text_hash")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a hash of the text, the hash h of the id and its two cells, of every row, without the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"), id_hash().alias("h"), F.xxhash64("text").alias("text_hash"))
    return rows.withColumns({"cell": F.shiftright("h", 60 - CELL_BITS), "sub": F.shiftright("h", 60 - 2 * CELL_BITS)})


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target, from one row (source, source_size) a source.

    The sources in order of code points (null last) get the weights in turn and share `share` times the whole; what
    exceeds `most` times a source's size goes to the others by weight until nothing exceeds. That has the closed form
    of filling to a level: in order of cap/weight, the first source whose cap is above its part of what is left sets
    the level for all from there on. The two windows run over one row a source.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest, everywhere = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(everywhere) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("part", F.col("left") / F.sum("w").over(rest))
    rows = rows.withColumn("level", F.max(F.when(F.col("cap") >= F.col("part") * F.col("w"), F.col("part"))).over(everywhere))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _boundary(cells: DataFrame, by: str) -> DataFrame:
    """Of a histogram (source, cell `by`, n words, budget): the last cell that begins within the budget, and the words before it."""
    run = W.partitionBy("source").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    rows = cells.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    return rows.where(F.col("before") < F.col("budget")).groupBy("source").agg(F.max(by).alias(by), F.max_by("before", by).alias("before"))


def thresholds(rows: DataFrame, **how: object) -> DataFrame:
    """One row a source: source_size, target, whole copies of every document, and where the threshold of the rest lies.

    The rest's budget is used up in the cell `cell`, there in the cell `sub`, with `before` words before that one.
    """
    first = cut(rows.groupBy("source", "cell").agg(F.sum("size").alias("n")))
    aims = targets(first.groupBy("source").agg(F.sum("n").alias("source_size")), **how)
    whole = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    aims = cut(aims.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    edge = cut(_boundary(_beside(first, aims.select("source", "budget")), "cell"))
    inside = _beside(rows.select("source", "cell", "sub", "size"), _small(edge.select("source", F.col("cell").alias("edge_cell")))).where("cell = edge_cell")
    second = inside.groupBy("source", "sub").agg(F.sum("size").alias("n"))
    left = _beside(aims.select("source", "budget"), edge.withColumnRenamed("before", "above"))
    fine = _boundary(_beside(second, left.select("source", (F.col("budget") - F.col("above")).alias("budget"))), "sub")
    fine = _beside(fine, edge.withColumnRenamed("before", "above")).select("source", "cell", "sub", (F.col("above") + F.col("before")).alias("before"))
    return cut(_beside(aims, fine, "left"))


def _beside(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the other columns of their source in by_source; a null source is a source."""
    other = by_source.withColumnRenamed("source", "_s")
    return rows.join(other, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")


def _small(by_source: DataFrame) -> DataFrame:
    """A table of one row a source that has been written: broadcast if its counted rows are few, else left to the planner."""
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_ROWS else by_source


def _cut_keys(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Of each source with a boundary cell, the last place (`edge`) that the budget reaches there, and how many rows of that place fit.

    Only the rows of boundary cells are ordered, and without their texts. The middles of rows rise with their order, so
    what is taken of a cell is its beginning, and one place a source says where it ends.
    """
    inside = _beside(rows.select("source", "sub", "size", _slim_place().alias("place")), _small(limits.where("sub is not null").select("source", F.col("sub").alias("_u"), "before", "budget"))).where("sub = _u")
    run = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)) + F.col("size") / 2
    taken = inside.withColumn("middle", middle).where(F.col("middle") <= F.col("budget")).groupBy("source", "place").agg(F.count("*").alias("fit"))
    return taken.groupBy("source").agg(F.max("place").alias("edge"), F.max_by("fit", "place").alias("fit"))


def settled(rows: DataFrame, **how: object) -> DataFrame:
    """One row a source of `rows` (of `sized`): source_size, target, whole copies, the cell `sub` of the boundary, edge and fit."""
    limits = thresholds(rows, **how)
    return cut(_beside(limits, _cut_keys(rows, limits), "left"))


def _with_copies(rows: DataFrame, limits: DataFrame, name: str, source: Column, h: Column, place: Column) -> tuple[DataFrame, str]:
    """rows with a column `name`, how often the mix takes the row by the limits of `settled`; and the name of the column that holds these.

    Working columns go under names that rows doesn't have. Rows are decided one by one against their source's limits, by
    their cell and, in the boundary cell alone, by their place; only rows that share the very place of a boundary (one id,
    size and text hash) are numbered.
    """
    mine, lim, at = free(rows, "_mix", "_limit", "_place")
    both = rows.withColumn(mine, F.struct(source.alias("source"), F.shiftright(h, 60 - 2 * CELL_BITS).alias("sub")))
    both = both.join(_small(limits.select(F.struct("*").alias(lim))), F.col(f"{mine}.source").eqNullSafe(F.col(f"{lim}.source")), "left")
    sub, edge_sub, edge, whole = F.col(f"{mine}.sub"), F.col(f"{lim}.sub"), F.col(f"{lim}.edge"), F.col(f"{lim}.whole")
    both = both.withColumn(at, F.when(F.coalesce(sub == edge_sub, F.lit(False)), place))
    at_edge = F.coalesce(F.col(at) == edge, F.lit(False))
    below = F.coalesce((sub < edge_sub) | (F.col(at) < edge), F.lit(False))
    number = F.row_number().over(W.partitionBy(f"{mine}.source", at).orderBy(f"{mine}.sub"))
    plain = both.where(~at_edge).withColumn(name, whole + below.cast("int"))
    tied = both.where(at_edge).withColumn(name, whole + (number <= F.col(f"{lim}.fit")).cast("int"))
    return plain.unionByName(tied).drop(mine, at), lim


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns keep their values, whatever their names."""
    limits = settled(cut(sized(docs)), **how)
    name, step = free(docs, "_copies", "_copy")
    rows, _ = _with_copies(docs.where(F.col("text").rlike(NOT_SPACE)), limits, name, F.col("source"), id_hash(), _place(id_hash(), F.col("doc_id"), word_count(), F.xxhash64("text")))
    return rows.where(F.col(name) > 0).withColumn(step, F.explode(F.sequence(F.lit(1), F.col(name)))).select(*map(quoted, docs.columns))


def mixture(docs: DataFrame, **how: object) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes of it, repeats counted) for every row of docs."""
    slim = cut(sized(docs))
    rows, lim = _with_copies(slim, settled(slim, **how), "copies", F.col("source"), F.col("h"), _slim_place())
    return rows.select("doc_id", "size", f"{lim}.source_size", f"{lim}.target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
