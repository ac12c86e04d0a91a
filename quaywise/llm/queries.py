"""The registered queries of this subpackage, each its operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaywise.llm import alignment, clusters, html_text, langid, media, minhash, mixing, quality, rlz, sentencepieces, simhash, token_counts, toxicity
from quaywise.llm.tables import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.profiles(docs))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trips(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.removal(table(spark, sf_dir, "documents"))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_simhash,
        op3_mixing,
        op4_language,
        op5_sentencepiece,
        op6_media,
        op7_quality,
        op8_html,
        op9_minhash,
        op10_substrings,
        op11_tokens,
        op12_clusters,
        op13_alignment,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _clusters_sql(rounds: int = clusters.ROUNDS) -> str:
    """Each round assigns by comparing with every centroid, and takes floors of exact quotients, as a pair of common tables."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT row, c.k AS cluster, list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance
  FROM kept, centre{r} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c.k) = 1)""")
        if r < rounds:
            steps.append(f"""
parts{r} AS (SELECT n.cluster, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM near{r} n JOIN kept USING (row), range(1, 65) AS t(i) GROUP BY n.cluster, i),
centre{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM centre{r} c LEFT JOIN
    (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM parts{r} GROUP BY cluster) m ON m.cluster = c.k)""")
    return f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS row FROM whole),
centre0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS k, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) <= 8),{",".join(steps)}
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY cluster) AS cluster_size
FROM near{rounds} n JOIN kept USING (row) JOIN centre{rounds} c ON c.k = n.cluster"""


ORACLES: dict[str, str] = {
    "op12_clusters": _clusters_sql(),
    "op3_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w,
         2.0::DOUBLE * source_size AS cap
  FROM totals),
run AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS part
  FROM weighted),
aims AS (
  SELECT source, source_size, least(cap, coalesce((max(CASE WHEN cap >= part * w THEN part END) OVER ()) * w, cap)) AS target
  FROM run),
placed AS (
  SELECT s.*, a.source_size, a.target, CASE WHEN a.target >= a.source_size THEN 1 ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, s.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE AS middle
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed""",
    "op8_html": r"""
WITH raw AS (
  SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS parts
  FROM pages),
blocks AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda b: trim(regexp_replace(
           replace(replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;?', '"', 'g'), '&#39;', '''', 'g'), '&lt;', '<'), '&gt;', '>')
           , '\s+', ' ', 'g'))), lambda b: b <> '') AS bs
  FROM raw)
SELECT page_id, url, t AS text, length(t)::BIGINT AS n_chars
FROM (SELECT page_id, url, regexp_replace(array_to_string(bs, chr(10) || chr(10)), '&amp;?', '&', 'g') AS t FROM blocks)""",
    "op10_substrings": rf"""
WITH docs AS (
  SELECT doc_id, {_WORDS} AS ws FROM documents),
words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM docs WHERE len(ws) >= 20)),
starts AS (
  SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM starts, range(20) AS t(k)),
kept AS (
  SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t, count(*) AS n
  FROM words w ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.i = c.i GROUP BY w.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id""",
}
