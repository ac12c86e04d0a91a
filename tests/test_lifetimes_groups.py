import datetime as dt

import pytest
from pyspark.sql import functions as F
from quaywise.streaming import lifetimes


@pytest.mark.parametrize("kinds", ["a long, b string", "a double, b date", "a timestamp, b boolean"])
def test_keys_share_groups(spark, tmp_path, monkeypatch, kinds):
    """Whatever kinds of keys share a group, nulls among them, the stretches are those of the table."""
    monkeypatch.setattr(lifetimes, "GROUPS", 3)
    made = {"long": lambda i: (1 << 53) + i, "string": str, "double": lambda i: i / 4, "date": lambda i: dt.date(2020, 1, 1 + i), "timestamp": lambda i: dt.datetime(2020, 1, 1, microsecond=1 + i), "boolean": lambda i: i % 2 == 0}
    one, two = (made[k.split()[1]] for k in kinds.split(", "))
    signs = [(None if i % 5 == 0 else one(i % 7), None if i % 4 == 0 else two(i % 3), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i * i % 997), f"v{i % 11}") for i in range(300)]
    rows = spark.createDataFrame([*signs, (None, None, dt.datetime(2025, 1, 1), "end")], f"{kinds}, ts timestamp, v string")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = lifetimes.of_stream(stream, ["a", "b"], "ts", F.col("v"), 900)
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination(200)
    want = lifetimes.of_table(rows, ["a", "b"], "ts", F.col("v"), 900).where("last_at < '2025-01-01'")
    assert sorted(map(str, spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want.collect())) != []
