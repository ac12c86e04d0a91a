"""Stored fact tables that loads change partition by partition, and the manifest of what has been loaded.

A store is a folder of Parquet files, partitioned by a column that follows from the key (the month of a key's date, a bucket
of its id). A load reads only the partitions that its rows fall in, merges them (`sinks.upserted`), and overwrites
just these: Spark writes the new files beside the table and moves them in when all tasks have ended, so a load that fails
changes nothing, and files of other partitions stay as they are. Then the manifest gets a row for the load. Should a
driver die between the two, the same load comes again, finds no row, and gives the same table, as an upsert does.

A source that the manifest has isn't loaded again, so a stream that repeats a batch after a restart doesn't either. Rows
with a null in the key are kept, one by one; a null partition value is a partition of its own. One load at a time may
write to a store.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaywise.sources import sinks

#: Partitions that one load may touch: their names come to the driver.
MOST_PARTITIONS = 10_000
MANIFEST = "source string, rows long, partitions int"


@dataclass(frozen=True)
class Store:
    """path: the folder; partition: the column it is partitioned by; key and replaced: see `sinks.upserted`."""

    path: str
    schema: str
    partition: str
    key: tuple[str, ...]
    replaced: tuple[str, ...]

    def _read(self, spark: SparkSession, path: str, schema: str) -> DataFrame:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path)

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows as they are now; an empty table before the first load."""
        return self._read(spark, self.path, self.schema)

    def manifest(self, spark: SparkSession) -> DataFrame:
        """source, rows and partitions of every load."""
        return self._read(spark, f"{self.path}.loads", MANIFEST)

    def loaded(self, spark: SparkSession, source: str) -> bool:
        return not self.manifest(spark).where(F.col("source") == source).limit(1).isEmpty()

    def load(self, incoming: DataFrame, source: str, order: str = "seq") -> int:
        """Merges rows (the table's columns and `order`) into the store; how many partitions were written, 0 for a source that is there."""
        spark = incoming.sparkSession
        if self.loaded(spark, source):
            return 0
        columns = self.table(spark).columns
        counts = incoming.groupBy(self.partition).count().limit(MOST_PARTITIONS + 1).collect()
        if len(counts) > MOST_PARTITIONS:
            raise ValueError(f"a load of more than {MOST_PARTITIONS} partitions; load it in parts")
        if counts:
            values = [r[0] for r in counts if r[0] is not None]
            touched = F.col(self.partition).isin(values) if values else F.lit(False)
            if len(values) < len(counts):
                touched = touched | F.col(self.partition).isNull()
            current = self.table(spark).where(touched).withColumn(order, F.lit(None).cast(incoming.schema[order].dataType))
            merged = sinks.upserted(current, incoming.select(*columns, order), list(self.key), list(self.replaced), order).select(columns)
            merged.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(self.partition).parquet(self.path)
        row = spark.createDataFrame([(source, sum(r["count"] for r in counts), len(counts))], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}.loads")
        return len(counts)

    def replace(self, incoming: DataFrame, source: str, order: str = "seq") -> None:
        """The store with nothing but these rows; the manifest begins anew. The old table stays until the new one is written."""
        spark = incoming.sparkSession
        none = spark.createDataFrame([], self.schema).withColumn(order, F.lit(None).cast(incoming.schema[order].dataType))
        columns = none.columns[:-1]
        rows = sinks.upserted(none, incoming.select(*columns, order), list(self.key), list(self.replaced), order).select(columns)
        rows.write.option("partitionOverwriteMode", "static").mode("overwrite").partitionBy(self.partition).parquet(self.path)
        row = incoming.agg(F.lit(source).alias("source"), F.count("*").alias("rows"), F.count_distinct(self.partition).cast("int").alias("partitions"))
        row.write.mode("overwrite").parquet(f"{self.path}.loads")

    def fed_by(self, stream: DataFrame, checkpoint: str, name: str = "stream", order: str = "seq"):
        """A writer of a stream whose batches are loads: started again from its checkpoint, it goes on where it was."""
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: self.load(rows, f"{name}-{n}", order) and None)
