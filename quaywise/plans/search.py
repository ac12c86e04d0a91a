"""Registered queries of the vector index and of full-text search, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaywise.operators import fulltext, retrieval, vector_index
from quaywise.plans.queries import query, r, rounded
from quaywise.session import cut, read
from quaywise.sources import office


def _index_sql(rounds: int = vector_index.ROUNDS) -> str:
    """Directions, the fitted centroids round by round, the cell of every vector and the cells that each query probes."""
    steps = []
    for n in range(rounds):
        steps.append(f"""
of{n} AS (SELECT row, c.cell FROM picked p, centre{n} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY list_sum(list_transform(list_zip(p.u, c.u), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), c.cell) = 1),
moved{n} AS (SELECT cell, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS u FROM (SELECT cell, i, sum(u[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM of{n} JOIN picked USING (row), range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1),
centre{n + 1} AS MATERIALIZED (SELECT cell, coalesce(m.u, c.u) AS u FROM centre{n} c LEFT JOIN moved{n} m USING (cell))""")
    return f"""raw AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS most FROM embeddings),
whole AS (SELECT vec_id, e, list_transform(e, lambda x: floor(x / most * 32767.0::DOUBLE)) AS w FROM raw WHERE most > 0),
pointed AS MATERIALIZED (SELECT vec_id, e, list_transform(w, lambda x: floor(4096.0::DOUBLE * x / sqrt(list_sum(list_transform(w, lambda y: y * y))))::BIGINT) AS u FROM whole),
picked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS row FROM pointed QUALIFY row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) <= {vector_index.SAMPLE}),
centre0 AS MATERIALIZED (SELECT row AS cell, u FROM picked WHERE row < (SELECT least({vector_index.MOST_CELLS}, floor(sqrt(count(*) - 1)) + 1) FROM embeddings)),{",".join(steps)},
near AS MATERIALIZED (SELECT vec_id, e, c.cell, row_number() OVER (PARTITION BY vec_id ORDER BY list_sum(list_transform(list_zip(p.u, c.u), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), c.cell) AS place FROM pointed p, centre{rounds} c),
tried AS (SELECT a.vec_id AS asked, b.vec_id FROM picked a, picked b WHERE a.row < {vector_index.TRIED} AND a.row <> b.row
 QUALIFY row_number() OVER (PARTITION BY a.row ORDER BY list_sum(list_transform(list_zip(a.u, b.u), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), b.row) <= 10),
places AS (SELECT q.place, row_number() OVER (ORDER BY q.place) AS n, count(*) OVER () AS total FROM tried t JOIN near v ON v.vec_id = t.vec_id AND v.place = 1 JOIN near q ON q.vec_id = t.asked AND q.cell = v.cell),
ivf AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.e, q.e) AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) AS INT) AS rank
 FROM near q JOIN near v ON v.cell = q.cell AND v.place = 1 WHERE q.vec_id % 20 = 0 AND q.place <= (SELECT place FROM places WHERE n = ceil({vector_index.RECALL}::DOUBLE * total)) QUALIFY rank <= 10)"""


def _asked(vectors):
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _ivf(spark, d):
    vectors = read(spark, d, "embeddings")
    cells = vector_index.fitted(vectors)
    return vector_index.search(vector_index.indexed(vectors, cells), vector_index.probed(_asked(vectors), cells), 10)


@query(f"WITH {_index_sql()} SELECT query_id, vec_id, {r('similarity')} AS similarity, rank FROM ivf")
def ivf_topk(spark, d):
    return rounded(_ivf(spark, d), "similarity")


@query(f"WITH {_index_sql()} SELECT cell, count(*) AS vectors, min(vec_id) AS first_id FROM near WHERE place = 1 GROUP BY cell")
def ivf_cells(spark, d):
    vectors = read(spark, d, "embeddings")
    return vector_index.indexed(vectors, vector_index.fitted(vectors)).groupBy(F.col("cell").cast("long").alias("cell")).agg(F.count("*").alias("vectors"), F.min("vec_id").alias("first_id"))


@query(
    f"""WITH {_index_sql()}, ex AS (SELECT q.vec_id AS query_id, v.vec_id FROM pointed v, pointed q WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.e, q.e) DESC, v.vec_id) <= 10)
SELECT {r("count(i.vec_id) / count(*)::DOUBLE")} AS recall, count(*) AS results FROM ex LEFT JOIN ivf i USING (query_id, vec_id)"""
)
def ivf_recall(spark, d):
    vectors = read(spark, d, "embeddings")
    return rounded(vector_index.recall(_ivf(spark, d), retrieval.dense_topk(vectors, _asked(vectors), 10)), "recall")


#: Questions as users type them, made of the words of the benchmark's passages: all of some, an alternative, a phrase, an exclusion.
TYPED = r"""typed AS (SELECT item_id AS query_id, w[1] || ' ' || w[2] || ' ' || w[3] || ' OR "' || w[4] || ' ' || w[5] || '" -' || w[6] || ' or -"' || w[7] || ' ' || w[8] || '" ' || w[9] AS query_text
 FROM (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM benchmark))"""
_STOP = ", ".join(f"'{w}'" for w in fulltext.STOP_WORDS)
_STEM = """CASE WHEN length(w) < 5 THEN w WHEN w LIKE '%x' THEN regexp_replace(regexp_replace(w, 'aux$', 'alx'), 'x$', '')
 WHEN length(b) > 1 AND right(b, 1) = substr(b, -2, 1) THEN left(b, length(b) - 1) ELSE b END"""
POSTINGS = rf"""placed AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents)),
terms AS MATERIALIZED (SELECT doc_id, place, {_STEM} AS term FROM (SELECT *, regexp_replace(w, '^(.{{4,}}?)é?e?r?s?$', '\1') AS b FROM placed WHERE w NOT IN ({_STOP})))"""
MATCHES = rf"""{TYPED}, {POSTINGS},
said AS (SELECT query_id, unnest(xs) AS said, generate_subscripts(xs, 1) AS item FROM (SELECT query_id, regexp_extract_all(lower(query_text), '-?"[^"]*"|[^\s"]+') AS xs FROM typed)),
itemed AS (SELECT *, sum(CASE WHEN said = 'or' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY item) AS clause, said LIKE '-%' AS negated FROM said),
asked AS (SELECT query_id, clause, item, negated, place, {_STEM} AS term FROM (SELECT *, regexp_replace(w, '^(.{{4,}}?)é?e?r?s?$', '\1') AS b
 FROM (SELECT query_id, clause, item, negated, unnest(ws) AS w, generate_subscripts(ws, 1) AS place FROM (SELECT *, regexp_extract_all(said, '[\p{{L}}\p{{N}}]+') AS ws FROM itemed WHERE said <> 'or')) WHERE w NOT IN ({_STOP}))),
words AS (SELECT *, max(place) OVER i - place AS behind, count(*) OVER i AS n FROM asked WINDOW i AS (PARTITION BY query_id, clause, item)),
ends AS (SELECT query_id, clause, item, negated, doc_id, t.place + behind AS place FROM terms t JOIN words w USING (term) GROUP BY 1, 2, 3, 4, 5, 6, n HAVING count(DISTINCT (term, behind)) = n),
fine AS (SELECT e.query_id, e.clause, doc_id FROM ends e JOIN (SELECT query_id, clause, count(DISTINCT item) AS needed FROM words WHERE NOT negated GROUP BY 1, 2) n ON e.query_id = n.query_id AND e.clause = n.clause
 GROUP BY 1, 2, 3, needed HAVING NOT bool_or(negated) AND count(DISTINCT item) = needed),
seen AS (SELECT e.*, row_number() OVER (PARTITION BY query_id, clause, doc_id ORDER BY place, item) AS i FROM ends e JOIN fine USING (query_id, clause, doc_id)),
last AS (SELECT b.query_id, b.clause, b.doc_id, b.i, b.place, a.item, max(a.i) AS li FROM seen b JOIN seen a ON a.query_id = b.query_id AND a.clause = b.clause AND a.doc_id = b.doc_id AND a.i <= b.i GROUP BY 1, 2, 3, 4, 5, 6),
begun AS (SELECT query_id, clause, doc_id, i, place, min(li) AS first, count(*) AS held FROM last GROUP BY 1, 2, 3, 4, 5),
covers AS (SELECT b.* FROM begun b JOIN (SELECT query_id, clause, count(DISTINCT item) AS needed FROM words WHERE NOT negated GROUP BY 1, 2) n ON b.query_id = n.query_id AND b.clause = n.clause AND b.held = n.needed
 QUALIFY row_number() OVER (PARTITION BY b.query_id, b.clause, doc_id, first ORDER BY i) = 1),
scored AS (SELECT c.query_id, c.doc_id, sum(0.1::DOUBLE / (1 + CASE WHEN c.place - s.place < c.i - c.first THEN (c.i - c.first) // 2 ELSE (c.place - s.place) - (c.i - c.first) END)) AS score FROM covers c JOIN seen s ON s.query_id = c.query_id AND s.clause = c.clause AND s.doc_id = c.doc_id AND s.i = c.first GROUP BY 1, 2)"""


def typed(spark, d):
    w = F.regexp_extract_all("text", F.lit(fulltext.WORD), F.lit(0))
    at = lambda k: F.get("w", F.lit(k - 1))
    parts = [at(1), " ", at(2), " ", at(3), ' OR "', at(4), " ", at(5), '" -', at(6), ' or -"', at(7), " ", at(8), '" ', at(9)]
    rows = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), w.alias("w"))
    return rows.select("query_id", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("query_text"))


@query(f"WITH {POSTINGS} SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS places, min(place) AS first_place FROM terms GROUP BY term")
def fulltext_index(spark, d):
    index = fulltext.postings(read(spark, d, "documents"))
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("places")).alias("places"), F.min(F.col("places")[0]).cast("long").alias("first_place"))


@query(f"WITH {MATCHES} SELECT query_id, doc_id, {r('score')} AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS INT) AS rank FROM scored QUALIFY rank <= 20")
def fulltext_topk(spark, d):
    asked = typed(spark, d)
    return rounded(fulltext.search(cut(fulltext.postings(read(spark, d, "documents"), asked)), asked, 20), "score")


@query("SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal FROM customer")
def office_rows(spark, d):
    """The customers written as workbooks next to where they are, and read back from these."""
    columns = ["c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"]
    customers = read(spark, d, "customer").select(*columns)
    rows = office.sheet_rows(office.workbooks(customers, rows=1000)).where("line > 1")
    return office.table(rows, columns).select(*[F.col(c).cast(customers.schema[c].dataType).alias(c) for c in columns])
