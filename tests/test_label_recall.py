from pyspark.sql import functions as F
from quaywise.operators import retrieval
from quaywise.plans import queries

DATA = "/root/testdata/sf0.001"


def test_recall_by_label_makes_no_pairs(spark, monkeypatch):
    labels = spark.createDataFrame([(i, None if i % 11 == 0 else i % 4) for i in range(90)], "item long, label int")
    asked = labels.where("item % 5 = 0").select(F.col("item").alias("query_id"), "label")
    found = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("rank")).withColumn("item", F.pmod(F.xxhash64("query_id", "rank"), F.lit(120)))
    pairs = asked.join(labels, "label").drop("label")
    assert retrieval.label_recall(found, asked, labels, 5).first() == retrieval.recall(found, pairs, 5).first()
    monkeypatch.setattr(retrieval, "recall", lambda *_: None)  # which is given pairs
    assert queries.recall_at_10(spark, DATA).first().queries > 0
