"""Document retrieval: chunks, exact dense search, lexical ranking, rank fusion, re-ranking, recall."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quaywise.functions.scalar import all_of, chain, ratio, tokens
from quaywise.sources import office

# Words of a chunk and of its overlap with the next, the constant of rank fusion, weights, intents and their words.
CHUNK, OVERLAP, RRF_K = 320, 64, 60
DENSE, LEXICAL, OVERLAP_WEIGHT = 0.60, 0.40, 0.20
INTENTS = {
    "stock": ("stock", "rupture", "inventaire", "disponib", "approvisionnement", "livraison", "réappro", "reappro", "entrepôt", "entrepot"),
    "vente": ("vente", "ventes", "vendre", "commercial", "chiffre", "revenu", "ca ", "c.a.", "souscription", "activation", "abonnement"),
    "prevision": ("prévision", "prevision", "forecast", "tendance", "prédiction", "prediction", "horizon", "futur", "projection"),
    "procedure": ("procédure", "procedure", "comment", "étapes", "etapes", "traitement", "processus", "comment faire", "démarche"),
}
#: Below this score of its best document a question isn't answered. Scores of fused ranks don't reach it, those of dense search do.
LEAST_SCORE, FUSED_K = 0.40, 20
#: Documents of these services are found for every service.
ANY_SERVICE = ("MULTI", "UNKNOWN")


def is_heading(block: str) -> bool:
    letters = re.sub("[^A-Za-z]", "", block)
    return 0 < len(block.split()) <= 14 and (block.startswith("#") or bool(re.match(r"\d+(\.\d+)*[).]?\s+", block)) or block.endswith(":") or letters.isupper() and len(letters) >= 4)


def blocks_of(text: str) -> list[str]:
    """Paragraphs with white space collapsed; a heading goes with the paragraph behind it, the last of several does."""
    out, held = [], None
    for block in (" ".join(b.split()) for b in re.split(r"\n\s*\n+", (text or "").replace("\r\n", "\n").replace("\r", "\n"))):
        if not block:
            continue
        if is_heading(block):
            out += [held] * (held is not None)
            held = block
        else:
            out.append(block if held is None else f"{held}\n{block}")
            held = None
    return out + [held] * (held is not None)


def chunks_of(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Chunks of a text of about `size` words: whole blocks as long as they fit, and pieces of longer ones; each chunk begins
    with the last words of the one before. Repeated chunks (upper and lower case aside) stay once."""
    size = max(80, size)
    overlap = max(0, min(overlap, size // 2))
    chunks: list[str] = []
    parts: list[str] = []
    words: list[str] = []

    def flush() -> None:
        nonlocal parts, words
        chunks.append("\n\n".join(parts))
        words = words[-overlap:] if overlap else []
        parts = [" ".join(words)] if words else []

    for block in blocks_of(text):
        every = block.split()
        for at in range(0, len(every), size):
            piece = every[at : at + size]
            if words and len(words) + len(piece) > size:
                flush()
            parts.append(" ".join(piece))
            words += piece
            if len(words) >= size:
                flush()
    if parts:
        chunks.append("\n\n".join(parts))
    first: dict[str, str] = {}
    for c in chunks:
        first.setdefault(c.strip().lower(), c)
    first.pop("", None)
    return list(first.values())


def chunked(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, source, chunk_index, chunk) of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(d, s, i, c) for d, s, t in zip(pdf["doc_id"], pdf["source"], pdf["text"], strict=True) for i, c in enumerate(chunks_of(t, size, overlap))]
            yield pd.DataFrame(out, columns=["doc_id", "source", "chunk_index", "chunk"])

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, chunk_index int, chunk string")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """source, doc_type, text and error of the files of a folder: text files and .docx whole, of others (and damaged ones) no text."""
    return office.documents(office.files(spark, path))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A file of one JSON object a line; blank lines are skipped."""
    return spark.read.json(path)


def ingested(store: DataFrame, docs: DataFrame) -> DataFrame:
    """The store of chunks (source, chunk_index, service, chunk, doc_type) with those of new documents (doc_id, source, text,
    service, doc_type): of one source, index and service the new chunk stays, of several new ones that of the smallest
    doc_id. Documents without text add nothing."""
    new = chunked(docs).join(docs.select("doc_id", F.upper(F.coalesce("service", F.lit("MULTI"))).alias("service"), "doc_type"), "doc_id").select("source", "chunk_index", "service", "chunk", "doc_type", "doc_id")
    per = W.partitionBy("source", "chunk_index", "service").orderBy("doc_id")
    new = new.withColumn("_n", F.row_number().over(per)).where("_n = 1").drop("_n", "doc_id")
    return store.join(new, ["source", "chunk_index", "service"], "left_anti").select(new.columns).unionByName(new)


def first_of_texts(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """Of rows of one text the one with the smallest key."""
    return chunks.withColumn("_f", F.min(key).over(W.partitionBy(F.md5(text)))).where(F.col(key) == F.col("_f")).drop("_f")


def described(vectors: DataFrame, column: str, metric: str = "COSINE") -> DataFrame:
    """The column of vectors, its dimension (least and most), metric and rows of a table."""
    return vectors.agg(F.lit(column).alias("vector_field"), F.min(F.size(column)).alias("least_dim"), F.max(F.size(column)).alias("most_dim"), F.lit(metric).alias("metric_type"), F.count("*").alias("row_count"))


def of_service(service: str | None, column: str = "service") -> Column:
    """Rows of a service, and those that are for every one; all rows if no service is given."""
    return F.lit(True) if not service else F.col(column).isin(service.upper(), *ANY_SERVICE)


def meets(doc_type: str | None = None, service: str | None = None, region: str | None = None, expression: str | None = None) -> Column:
    """All of the given equalities, and a condition in SQL."""
    same = lambda c, v: None if not v else F.col(c) == v.strip()
    return all_of([same("doc_type", doc_type), same("service", service), same("region", region), F.expr(expression) if expression and expression.strip() else None])


def sliding_chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Runs of words without regard to blocks, in column functions alone."""
    step, words = size - overlap, F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - overlap - 1), F.lit(step))
    rows = docs.select("doc_id", words.alias("_w")).where(F.size("_w") > 0).select("doc_id", "_w", F.posexplode(starts).alias("chunk_index", "_s"))
    return rows.select("doc_id", "chunk_index", F.array_join(F.slice("_w", F.col("_s") + 1, F.lit(size)), " ").alias("chunk"))


def duplicate_texts(docs: DataFrame) -> DataFrame:
    """Texts (outer blanks and case aside) that occur more than once: first id, number, ids in order."""
    same = docs.groupBy(F.md5(F.lower(F.trim("text"))).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return same.where("copies > 1")


#: Most similarities that a task holds at a time, bound of a product's relative error, and blocks that small tables are dealt into.
HELD, SLACK, LEAST_BLOCKS = 1 << 18, 1e-10, 16
#: Distinct words of its documents that a block holds in the mean, at most.
WORDS = 1 << 18


def _likeness(metric: str, v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What orders each of the queries (rows) with each of the vectors, as products of matrices, and a bound of its error a query."""
    vv, qq = (v * v).sum(axis=1), (q * q).sum(axis=1)
    out, most = q @ v.T, np.fmax.reduce(vv, initial=0.0)
    if metric == "l2":
        return 2.0 * out - vv[None, :], SLACK * (qq + most)
    if metric == "ip":
        return out, SLACK * np.sqrt(qq * most)
    length = np.sqrt(qq)[:, None] * np.sqrt(vv)[None, :]
    return np.divide(out, length, out=np.full_like(out, np.nan), where=length > 0), np.full(len(q), SLACK)


def _similarity(metric: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Similarity of queries and vectors row by row, the same wherever the row stands; NaN where the cosine has no length to go by."""
    if metric == "l2":
        return -np.sqrt(((v - q) ** 2).sum(axis=1))
    out = (v * q).sum(axis=1)
    if metric == "ip":
        return out
    length = np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))
    return np.divide(out, length, out=np.full_like(out, np.nan), where=length > 0)


def _first_copies(v: np.ndarray, k: int) -> np.ndarray:
    """Rows of v without those that k equal rows precede."""
    _, of = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1])))[:, 0], return_inverse=True)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], of[order], side="left")
    return np.sort(order[np.arange(len(order)) - starts < k])


FOUND = "query_id long, vec_id long, similarity double"


def best_of(metric: str, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For a group of vectors and one of queries (id, v): the k vectors that are nearest to each query, ties by id.

    Queries go in slices of HELD similarities. Products of matrices say which vectors can be among the best; only of these
    similarities are computed one by one. Of equal vectors the k first ids are compared.
    """

    def best(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})
        if vs.empty or qs.empty:
            return none
        vs = vs.sort_values("id")
        v, q = np.stack(vs["v"]).astype(np.float64, copy=False), np.stack(qs["v"]).astype(np.float64, copy=False)
        if v.shape[1] != q.shape[1]:
            raise ValueError(f"vectors of {v.shape[1]} components meet queries of {q.shape[1]}")
        if not v.shape[1]:
            return none if metric == "cosine" else pd.DataFrame([(x, y, 0.0) for x in qs["id"] for y in vs["id"][:k]], columns=list(none))
        ids, asked, out = vs["id"].to_numpy(), qs["id"].to_numpy(), []
        some = _first_copies(v, k)
        v, ids = v[some], ids[some]
        step, few = max(1, HELD // len(v)), min(k, len(v))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            with np.errstate(all="ignore"):
                far, slack = _likeness(metric, v, part)
                np.negative(far, out=far)
                last = np.partition(far, few - 1, axis=1)[:, few - 1] + 2.0 * slack
                row, col = np.nonzero(~(far > last[:, None]))  # what isn't a number is looked at
                sims = np.concatenate([_similarity(metric, v[col[i : i + 16384]], part[row[i : i + 16384]]) for i in range(0, len(row), 16384)])
            row, col, sims = (x[~np.isnan(sims)] for x in (row, col, sims))
            order = np.lexsort((col, -sims, row))
            row, col, sims = row[order], col[order], sims[order]
            near = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
            out.append(pd.DataFrame({"query_id": asked[at + row[near]], "vec_id": ids[col[near]], "similarity": sims[near]}))
        return pd.concat(out)

    return best


def numbers(rows: DataFrame, column: str) -> Column:
    """A column of vectors as it is shuffled: floats stay floats, all else becomes doubles."""
    return F.col(column) if rows.schema[column].dataType == ArrayType(FloatType(), True) else F.col(column).cast("array<double>")


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = 8192) -> DataFrame:
    """Exact nearest vectors of a stated set of queries (query_id, query): every block of vectors meets every block of queries
    in a group of its own, as a product of two matrices, and the best k a query and block are ranked together.

    Blocks hold about `block` vectors or queries, whatever the sizes of the tables, and a task HELD similarities at a time:
    a task's memory depends on neither table. Small tables of vectors are dealt into LEAST_BLOCKS smaller ones, so that all cores
    work. Vectors of another dimension than the query's are an error; ties are ordered by id.
    """
    if metric not in ("cosine", "ip", "l2") or not 1 <= k <= 100:
        raise ValueError("the metric is cosine, ip or l2, and k lies between 1 and 100")
    number = lambda t, least: t.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block), F.least(F.lit(least), F.ceil(F.count("*") / 512))).cast("int"))
    counts = {"_nv": number(vectors, LEAST_BLOCKS).scalar(), "_nq": number(queries, 1).scalar()}
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = vectors.select(F.col("vec_id").alias("id"), numbers(vectors, "embedding").alias("v")).withColumns(counts).withColumn("vb", deal("id", "_nv")).withColumn("qb", every("_nq")).drop("_nv", "_nq")
    right = queries.select(F.col("query_id").alias("id"), numbers(queries, "query").alias("v")).withColumns(counts).withColumn("qb", deal("id", "_nq")).withColumn("vb", every("_nv")).drop("_nv", "_nq")

    found = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(best_of(metric, k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def best_texts(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a group of documents' words (doc_id, term, weight) and one of queries' words (query_id, term): the k documents with
    the largest sums of weights for each query by nine digits, ties by id. Documents go in slices of HELD weights,
    queries in slices of eight times as many."""

    def best(hits: pa.Table, asked: pa.Table) -> pa.Table:
        values, at, known = _places(hits, asked)
        return _best_texts(k, values, asked, hits["doc_id"].to_numpy()[known], at, hits["weight"].to_numpy()[known])

    return best


def _places(hits: pa.Table, asked: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of queries, the place among them of each word of documents that is one, and which of these are."""
    values = pc.unique(asked["term"])
    at = pc.index_in(hits["term"], value_set=values).fill_null(-1).to_numpy()
    known = at >= 0
    return values, at[known], known


def _best_texts(k: int, values: pa.Array, asked: pa.Table, doc: np.ndarray, at: np.ndarray, weight: np.ndarray) -> pa.Table:
    """`best_texts` of documents, places of their words and weights."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ids, doc = np.unique(doc, return_inverse=True)
    queries, query = np.unique(asked["query_id"].to_numpy(), return_inverse=True)
    term = pc.index_in(asked["term"], value_set=values).to_numpy()
    order = np.argsort(doc, kind="stable")
    doc, at, weight = doc[order], at[order], weight[order]
    wide = max(1, 8 * HELD // max(len(values), 1))
    step = max(1, HELD // max(len(values), min(wide, len(queries)), 1))
    for begin in range(0, len(queries), wide):
        here = (query >= begin) & (query < begin + wide)
        has = np.zeros((len(values), min(wide, len(queries) - begin)))
        has[term[here], query[here] - begin] = 1.0
        for first in range(0, len(ids), step):
            lo, hi = np.searchsorted(doc, [first, first + step])
            part = np.zeros((min(step, len(ids) - first), len(values)))
            np.add.at(part, (doc[lo:hi] - first, at[lo:hi]), weight[lo:hi])
            scores = (part @ has).T
            far, few = np.where(scores > 0, -np.round(scores, 9), np.inf), min(k, len(part))
            q, d = np.nonzero((far <= np.partition(far, few - 1, axis=1)[:, few - 1 : few]) & (far < np.inf))
            out.append((begin + q, first + d, scores[q, d]))
            if len(out) > 1 and sum(len(x[0]) for x in out) > 4 * k * len(queries):
                out = [_first_texts(k, *map(np.concatenate, zip(*out, strict=True)))]
    q, d, score = _first_texts(k, *map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return pa.table({"query_id": pa.array(queries[q], pa.int64()), "doc_id": pa.array(ids[d], pa.int64()), "score": pa.array(score, pa.float64())})


def _first_texts(k: int, query: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of each query by score to nine digits, ties by document."""
    order = np.lexsort((doc, -np.round(score, 9), query))
    query, doc, score = query[order], doc[order], score[order]
    first = np.arange(len(query)) - np.searchsorted(query, query, side="left") < k
    return query[first], doc[first], score[first]


def weighted_texts(k: int, k1: float, b: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """`best_texts` of counted words: of a group of documents (doc_id, len, term, tf) and of queries (query_id, term, idf, mean)."""

    def found(hits: pa.Table, asked: pa.Table) -> pa.Table:
        values, at, known = _places(hits, asked)
        idf = np.zeros(len(values))
        idf[pc.index_in(asked["term"], value_set=values).to_numpy()] = asked["idf"].to_numpy()
        tf, length = hits["tf"].to_numpy()[known], hits["len"].to_numpy()[known]
        mean = asked["mean"][0].as_py() if len(at) else 1.0
        weight = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        return _best_texts(k, values, asked, hits["doc_id"].to_numpy()[known], at, weight)

    return found


def lexical_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, block: int = 4096) -> DataFrame:
    """BM25 of every document for each query (query_id, query_text).

    A document's length is the number of its words; of its words only those that some query has are counted, next to the
    scan, as the words of the queries are few and the planner broadcasts them if their size allows it. Blocks of about
    `block` documents and WORDS of their words at most meet blocks of an eighth as many queries in groups of their own, as
    products of their weights; the best k of a query and block are ranked together. How rare a word is comes with the queries.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    deal = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
    words = docs.select("doc_id", tokens(F.col("text")).alias("_t")).withColumn("len", F.size("_t"))
    # the empty word stands for the document itself, so that numbers and lengths come from the same pass
    wanted = asked.select("term").distinct().unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term")))
    hits = words.select("doc_id", "len", F.explode(F.array_append("_t", F.lit(""))).alias("term")).join(wanted, "term").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    # tf is read by all that use hits, and no row left out: else texts would be read and counted once more
    itself = F.when(F.col("term") == "", F.col("tf"))
    own = F.when(F.col("len") > 0, itself)
    blocks = lambda rows, n: F.ceil(F.coalesce(rows, F.lit(0)) / n)
    stats = hits.agg(F.struct(F.sum(own).alias("n"), (F.sum(own * F.col("len")) / F.sum(own)).alias("mean"), F.greatest(F.lit(1), blocks(F.sum(itself), block), blocks(F.count_if(F.col("tf") > 0), WORDS)).cast("int").alias("nd"))).scalar()
    nq = queries.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / max(1, block // 8))).cast("int")).scalar()
    df = hits.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")).withColumn("_s", stats)
    idf = F.log(1 + (F.col("_s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    left = hits.select(F.col("doc_id").cast("long"), "len", "term", "tf").withColumns({"_nd": stats["nd"], "_nq": nq})
    left = left.withColumn("_db", deal("doc_id", F.col("_nd"))).withColumn("_qb", every(F.col("_nq"))).drop("_nd", "_nq")
    right = asked.join(df.select("term", idf.alias("idf"), F.col("_s.mean").alias("mean"), F.col("_s.nd").alias("_nd")), "term").withColumn("_nq", nq)
    right = right.select(F.col("query_id").cast("long"), "term", "idf", "mean", deal(F.col("query_id").cast("long"), F.col("_nq")).alias("_qb"), every(F.col("_nd")).alias("_db"))
    scored = left.groupBy("_db", "_qb").cogroup(right.groupBy("_db", "_qb")).applyInArrow(weighted_texts(k, k1, b), "query_id long, doc_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid(dense: DataFrame, lexical: DataFrame, texts: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best documents of each query with the way they were found: hybrid where both lists (query_id, doc_id, rank,
    similarity or score) have something for the query, else the one that has, by its own score.

    Fused ranks are cut to the first FUSED_K; then the share of the query's words that a document (doc_id, text) has is
    added. Ties are ordered by id.
    """
    first = lambda rows, c: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(c), "doc_id"))
    both = fused(dense, lexical).join(dense.select("query_id", "doc_id", "similarity"), ["query_id", "doc_id"], "left").join(lexical.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
    per = W.partitionBy("query_id")
    both = both.withColumns({"_d": F.count("dense_rank").over(per), "_x": F.count("lexical_rank").over(per)})
    both = both.withColumn("mode", chain([((F.col("_d") > 0) & (F.col("_x") > 0), "hybrid"), (F.col("_d") > 0, "dense_only")], "lexical_only"))
    both = both.withColumn("fused", F.round(chain([(F.col("mode") == "hybrid", F.col("fused")), (F.col("mode") == "dense_only", F.col("similarity"))], F.col("score")), 6))
    both = both.withColumn("_r", first(both, "fused")).where(F.col("_r") <= FUSED_K)
    rows = both.join(queries, "query_id", "left").join(texts, "doc_id", "left")
    out = overlap_reranked(rows, "query_text", "text").withColumn("final", F.round("final", 6))
    return out.withColumn("rank", first(out, "final")).where(F.col("rank") <= k).select("query_id", "doc_id", "mode", "overlap", "final", "rank")


def fused(dense: DataFrame, lexical: DataFrame, w_dense: float = DENSE, w_lexical: float = LEXICAL) -> DataFrame:
    """Weighted reciprocal ranks of both lists (query_id, doc_id, rank)."""
    d = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    part = lambda c, w: F.coalesce(F.lit(w) / (F.lit(RRF_K) + F.col(c)), F.lit(0.0))
    return d.join(x, ["query_id", "doc_id"], "full").withColumn("fused", part("dense_rank", w_dense) + part("lexical_rank", w_lexical))


def overlap_reranked(rows: DataFrame, question: str, text: str, weight: float = OVERLAP_WEIGHT) -> DataFrame:
    """Adds the share of the question's distinct words that the text has."""
    q, t = F.array_distinct(tokens(F.col(question))), F.array_distinct(tokens(F.col(text)))
    share = ratio(F.size(F.array_intersect(q, t)), F.size(q), 0.0)
    return rows.withColumns({"overlap": share, "final": F.col("fused") + weight * share})


def recall(found: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Mean share of the expected items (query_id, item) among the first k found (query_id, item, rank)."""
    hits = found.where(F.col("rank") <= k).join(expected, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    size = expected.groupBy("query_id").agg(F.count("*").alias("size"))
    return size.join(hits, "query_id", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"), F.count("*").alias("queries"))


def label_recall(found: DataFrame, asked: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """`recall` where the expected items of a query (query_id, label) are all items (item, label) of its label: these are counted
    by label and looked up for what was found, so that no pairs of queries and items are made."""
    hits = found.where(F.col("rank") <= k).select("query_id", "item").join(asked.distinct(), "query_id").join(labels, ["item", "label"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    size = asked.join(labels.groupBy("label").agg(F.count("*").alias("n")), "label").groupBy("query_id").agg(F.sum("n").alias("size"))
    return size.join(hits, "query_id", "left").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"), F.count("*").alias("queries"))


def fetched(vectors: DataFrame, ids: list[int]) -> DataFrame:
    """Rows by a list of ids, in its order; ids that don't exist are left out."""
    asked = vectors.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, vec_id long")
    return asked.join(vectors, "vec_id").select("pos", "vec_id", "label")


def intent(text: Column) -> Column:
    """The first kind of question one of whose words the text has."""
    t = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    return chain([(has(words), name) for name, words in INTENTS.items()], "general")


def context(found: DataFrame, texts: DataFrame) -> DataFrame:
    """For each query its documents (query_id, doc_id, rank) as one text in order of rank, and their sources, each once."""
    rows = found.join(texts, "doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "source", "text")))
    return rows.groupBy("query_id").agg(ordered.alias("o")).select(
        "query_id", F.array_join(F.transform("o", lambda x: F.concat(F.lit("[SOURCE: "), x["source"], F.lit("] "), x["text"])), "\n\n").alias("context"), F.array_distinct(F.transform("o", lambda x: x["source"])).alias("sources")
    )
