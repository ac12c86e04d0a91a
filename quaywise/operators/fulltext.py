"""Full-text search: a positional inverted index, web-style queries, ranks by cover density.

A text's words are its runs of letters and digits, lower-cased; French function words are left out but keep their places;
the others lose their endings by a minimal stemmer (plural, feminine and infinitive endings, doubled last letters). Texts
become words in column functions; tasks then stem the distinct words of some documents and sort numbers. The index has a row for each stem and document, with its places.

A query is what a user types: words that must all occur, "words in quotes" that must follow each other at the same
distances, -word or -"a phrase" that must not occur, and `or` between alternatives, each a conjunction of its own. Words that the
language writes as one (l'offre, e-mail) are a phrase. An alternative with nothing but exclusions or function words finds
nothing, nor does an empty query.

A document's rank is the sum over its covers: the shortest stretches that hold every word and phrase of an alternative
(none inside another), each 0.1 over 1 plus the number of places in it that are none of the query's (where several items lie at one place and
that number would be negative, half of what it holds behind its first); alternatives add up. A phrase counts at its last word. Places aren't capped, so long documents are ranked by all of their text.

Of a search only words that some query has are kept. An alternative meets the documents that hold the rarest of its words,
in an equi-join whose smaller side the planner broadcasts if its size allows it; all else is looked up in the places of one
document, however frequent a word is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaywise.functions.scalar import chain

# Function words of French, and the weight of a place.
STOP_WORDS = (
    "au aux avec ce ces dans de des du elle elles en et eux il ils je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses "
    "son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y est sont était été être a ai as ont avait avoir"
).split()
WEIGHT = 0.1
STOPPED, ENDING = frozenset(STOP_WORDS), re.compile("^(.{4,}?)é?e?r?s?$")
#: Words that a task groups by term at a time.
AT_ONCE = 1 << 19
WORD, ITEM = r"[\p{L}\p{N}]+", r'-?"[^"]*"|[^\s"]+'


def stemmed(w: Column) -> Column:
    """A lower-cased word without its ending, if at least four letters stay."""
    bare = F.regexp_replace(w, "^(.{4,}?)é?e?r?s?$", "$1")
    once = F.regexp_replace(bare, r"(.)\1$", "$1")
    plural = F.regexp_replace(F.regexp_replace(w, "aux$", "alx"), "x$", "")
    return chain([(F.char_length(w) < 5, w), (F.endswith(w, F.lit("x")), plural)], once)


def terms(text: Column) -> Column:
    """The stems of a text with their places, from 1 on, as an array of (term, place)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    placed = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + 1).alias("place")))
    kept = F.filter(placed, lambda x: ~x["w"].isin(*STOP_WORDS))
    return F.transform(kept, lambda x: F.struct(stemmed(x["w"]).alias("term"), x["place"].alias("place")))


def stem(word: str) -> str:
    """What `stemmed` makes of a word."""
    if len(word) < 5:
        return word
    if word.endswith("x"):
        return word[:-3] + "al" if word.endswith("aux") else word[:-1]
    bare = ENDING.sub(r"\1", word)
    return bare[:-1] if bare[-1] == bare[-2] else bare


def _slices(words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs (first, behind the last) of documents with so many words, AT_ONCE or a single document at most."""
    ends, first = np.cumsum(words), 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
        yield first, last
        first = last


def _by_terms(ids: pa.Array, texts: pa.ListArray) -> pa.RecordBatch:
    """term, doc_id and ordered places of documents (lists of texts, these lists of words). Each distinct word is stemmed once."""
    each = texts.flatten()
    lengths = each.value_lengths().to_numpy()
    doc = np.repeat(pc.list_parent_indices(texts).to_numpy(), lengths)
    place = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    words = each.flatten().dictionary_encode()
    stems = pa.array([None if w in STOPPED else stem(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    term = stems.indices.fill_null(-1).to_numpy()[words.indices.to_numpy()]
    kept, n, far = term >= 0, max(len(stems.dictionary), 1), int(place.max(initial=0)) + 1
    # document, term and place as one number, below 2^60 for AT_ONCE words
    key = np.sort((doc[kept].astype(np.int64) * n + term[kept]) * far + place[kept])
    pair, place = key // far, (key % far).astype(np.int32)
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(pair)).astype(np.int32)), pa.array(place))
    return pa.RecordBatch.from_arrays([stems.dictionary.take(pa.array(pair[starts] % n)), ids.take(pa.array(pair[starts] // n)), lists], ["term", "doc_id", "places"])


def postings(docs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """The inverted index of documents (doc_id, text): term, doc_id and the ordered places of the term. Rows of one id are one
    document whose texts have their places side by side; null texts have no terms. Given queries, only their terms are in it.

    Texts are brought together by document, not words with their places: a document's words are grouped where it is."""
    words = F.transform("texts", lambda t: F.regexp_extract_all(F.lower(t), F.lit(WORD), F.lit(0)))
    whole = docs.select("doc_id", "text").repartition("doc_id").groupBy("doc_id").agg(F.collect_list("text").alias("texts")).select("doc_id", words.alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("words")
            ends = np.append(0, np.cumsum(texts.flatten().value_lengths().to_numpy()))
            counts = np.diff(ends[np.append(0, np.cumsum(texts.value_lengths().to_numpy()))])
            for first, last in _slices(counts):
                yield _by_terms(ids.slice(first, last - first), texts.slice(first, last - first))

    fields = [T.StructField("term", T.StringType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("places", T.ArrayType(T.IntegerType()))]
    rows = whole.mapInArrow(run, T.StructType(fields))
    return rows if queries is None else rows.join(parsed(queries).select("term").distinct(), "term", "left_semi")


def saved(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes an index in folders by hash of the term, each sorted by term, so that a look-up reads few row groups."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    index.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("term", "doc_id").write.partitionBy("bucket").parquet(path)


def parsed(queries: DataFrame) -> DataFrame:
    """The items of queries (query_id, query_text), a row a word: query_id, clause (alternative), item, negated, term, offset in
    the item, and the item's words and length."""
    items = F.regexp_extract_all(F.lower(F.coalesce("query_text", F.lit(""))), F.lit(ITEM), F.lit(0))
    rows = queries.select("query_id", items.alias("items")).select("query_id", "items", F.posexplode("items").alias("item", "said"))
    rows = rows.where("said <> 'or'").withColumn("clause", F.size(F.filter(F.slice("items", 1, F.col("item")), lambda x: x == "or")))
    rows = rows.select("query_id", "clause", "item", F.startswith("said", F.lit("-")).alias("negated"), terms(F.col("said")).alias("t"))
    last = F.array_max(F.transform("t", lambda x: x["place"]))
    return rows.select("query_id", "clause", "item", "negated", F.size("t").alias("words"), last.alias("_last"), F.explode("t").alias("x")).select(
        "query_id", "clause", "item", "negated", "words", "x.term", (F.col("_last") - F.col("x.place")).alias("behind")
    )


def _density(places: Column, items: Column) -> Column:
    """Cover density of one document's places: an ordered array of (place, item), for items numbered 0 to items - 1.

    Goes along the places and keeps for each item the index and place of its last one. The stretch from the earliest of
    these to the present place is a cover if it begins later than the one before.
    """
    none = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("place"))
    start = F.struct(F.array_repeat(none, items).alias("last"), F.lit(-1).alias("begin"), F.lit(0).alias("i"), F.lit(0.0).alias("score"))

    def step(s: Column, x: Column) -> Column:
        now = F.transform(s["last"], lambda old, k: F.when(k == x["item"], F.struct(s["i"].alias("i"), x["place"].alias("place"))).otherwise(old))
        return F.struct(now.alias("last"), s["begin"].alias("begin"), s["i"].alias("i"), s["score"].alias("score"), F.array_min(now).alias("first"), x["place"].alias("end"))

    def scored(t: Column) -> Column:
        new = (t["first"]["i"] >= 0) & (t["first"]["i"] > t["begin"])
        others = t["i"] - t["first"]["i"]
        noise = (t["end"] - t["first"]["place"]) - others
        noise = F.when(noise < 0, F.floor(others / 2)).otherwise(noise)  # items at one place
        return F.struct(
            t["last"].alias("last"),
            F.when(new, t["first"]["i"]).otherwise(t["begin"]).alias("begin"),
            (t["i"] + 1).alias("i"),
            (t["score"] + F.when(new, F.lit(WEIGHT) / (1 + noise)).otherwise(0.0)).alias("score"),
        )

    one = lambda s, x: F.transform(F.array(step(s, x)), scored)[0]  # noqa: E731  the step is computed once, not wherever it is used
    return F.aggregate(places, start, one, lambda s: s["score"])


def matches(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id and score of every document that meets a query."""
    word = F.struct("term", "behind")
    items = parsed(queries).groupBy("query_id", "clause", "item", "negated").agg(F.collect_set(word).alias("words"))
    one = F.when(~F.col("negated"), F.struct("item", "words"))
    clauses = items.groupBy("query_id", "clause").agg(F.array_sort(F.collect_list(one)).alias("items"), F.collect_list(F.when(F.col("negated"), F.col("words"))).alias("not")).where(F.size("items") > 0)
    # `places` is asked for wherever the index is read, so that it is computed once
    rows = index.where(F.size("places") > 0)
    needed = clauses.select("query_id", "clause", F.explode(F.array_distinct(F.flatten(F.transform("items", lambda x: F.transform(x["words"], lambda w: w["term"]))))).alias("term"))
    often = rows.join(needed.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("places")).alias("often"))
    rarest = needed.join(often, "term", "left").groupBy("query_id", "clause").agg(F.min_by("term", F.struct(F.coalesce("often", F.lit(0)), F.col("term"))).alias("term"))
    found = rows.select("term", "doc_id").join(rarest.join(clauses, ["query_id", "clause"]), "term").drop("term")
    bags = rows.join(parsed(queries).select("term").distinct(), "term", "left_semi").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
    # Places of a whole item: those of its last word that its other words lie before as in the query.
    ends = lambda words: F.transform(words, lambda w: F.transform(F.col("at")[w["term"]], lambda p: p + w["behind"]))
    whole = lambda words: F.coalesce(F.aggregate(ends(words), F.element_at(ends(words), 1), F.array_intersect), F.array().cast("array<int>"))
    met = found.join(bags, "doc_id").where(F.forall("items", lambda x: F.forall(x["words"], lambda w: F.map_contains_key("at", w["term"]))))
    met = met.select("query_id", "doc_id", F.transform("items", lambda x: whole(x["words"])).alias("places"), F.exists("not", lambda words: F.size(whole(words)) > 0).alias("out"))
    met = met.where(~F.col("out") & F.forall("places", lambda x: F.size(x) > 0))
    at = F.array_sort(F.flatten(F.transform("places", lambda x, i: F.transform(x, lambda p: F.struct(p.cast("int").alias("place"), i.alias("item"))))))
    return met.select("query_id", "doc_id", _density(at, F.size("places")).alias("score")).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k documents of each query with the best ranks: query_id, doc_id, score, rank; ties are ordered by id."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return matches(index, queries).withColumn("rank", rank).where(F.col("rank") <= k)
