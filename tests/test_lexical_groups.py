"""Lexical search: what a group of Python holds is bounded by words, and every text is read and counted once."""

import pyarrow as pa
from quaywise.operators import retrieval


def tables(spark, n=60, words=40):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 70}x" for j in range(words))) for i in range(n)], "doc_id long, text string")
    return docs, spark.createDataFrame([(q, " ".join(f"w{j}x" for j in range(q, 70))) for q in range(3)], "query_id long, query_text string")


def test_groups_of_documents_with_many_words_are_small(spark, monkeypatch):
    def sizes(k, *_):
        return lambda hits, asked: pa.table({"query_id": pa.array([0]), "doc_id": pa.array([0]), "score": pa.array([float(hits.num_rows)])})

    monkeypatch.setattr(retrieval, "WORDS", 200, raising=False)
    monkeypatch.setattr(retrieval, "weighted_texts" if hasattr(retrieval, "weighted_texts") else "best_texts", sizes)
    found = [r.score for r in retrieval.lexical_topk(*tables(spark), 100).collect()]
    assert sum(found) in (2400.0, 2460.0) and len(found) > 8 and max(found) < 600


def test_small_groups_find_the_same(spark, monkeypatch):
    rows = lambda: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in retrieval.lexical_topk(*tables(spark), 7).collect())
    want = rows()
    monkeypatch.setattr(retrieval, "WORDS", 200, raising=False)
    assert len(want) == 21 and rows() == want


def test_texts_are_counted_once(spark, tmp_path):
    docs, asked = tables(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = retrieval.lexical_topk(spark.read.parquet(f"{tmp_path}/documents.parquet"), asked, 5)
        plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1
