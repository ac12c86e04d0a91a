"""From raw documents to token ids: quality filter, near-dedup, substring dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. A pass over an empty table gives an
empty table; null texts count as empty; columns that a stage doesn't know keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.llm import jaccard, mixing, quality, rlz, sentencepieces
from quaywise.llm.tables import dropped, free, stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.5 or more)."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    (score,) = free(docs, "_score")
    return docs.withColumn(score, quality.score_column(docs, model)).where(F.col(score) >= 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of five-word shingles alike), the document with the smallest id."""
    return jaccard.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages of 20 words or more that occur earlier."""
    return rlz.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the number of these; where docs has columns of these names, with an underscore behind."""
    ids, number = free(docs, "token_ids", "n_tokens")
    return sentencepieces.encoded(docs, name=ids).withColumn(number, F.size(ids).cast("long"))


STAGES = [
    ("7 quality classifier", keep_quality),
    ("2 SimHash near-dedup", drop_near_duplicates),
    ("10 substring dedup", drop_repeated_passages),
    ("3 mixing sources", mix_sources),
    ("5 SentencePiece encoding", encode),
]

#: Hashes and trained models can't be had in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage keeps is written to the shared folder and read again, and the table before it goes."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = stored(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
