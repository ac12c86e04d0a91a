"""Reading inputs, and cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a regular expression for the JVM.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from every column of df (upper or lower case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name for Spark, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, else the checkpoint folder that was set on its context.

    Where neither is set, a temporary folder serves a local session, as in tests; on a cluster that is an error, as
    executors elsewhere couldn't read it.
    """
    sc = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for rows that carry texts."""
    return df.sparkSession.read.parquet(stored(df))


def stored(df: DataFrame) -> str:
    """The path of a new Parquet table in the shared folder that holds df."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that `stored` has written."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, train: Column, max_rows: int) -> DataFrame:
    """At most max_rows documents (text, label) that have a 0/1 label and lie in the training folds.

    The ids with the lowest hash are taken, so the choice doesn't depend on the order of rows. Twice max_rows ids (8 bytes
    each) are broadcast, as some may have no document; texts move only for those. Ids that labels contradict are left
    out.
    """
    ids = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.min(target).alias("label"), F.max(target).alias("_other"))
        .where(F.col("label") == F.col("_other"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .select("doc_id", F.col("label").cast("int").alias("label"))
        .limit(2 * max_rows)
    )
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), "doc_id")
    order = [F.xxhash64("doc_id"), F.xxhash64("text"), F.col("doc_id")]
    return rows.orderBy(*order).limit(max_rows).select("text", "label")
