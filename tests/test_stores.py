from pathlib import Path

import pytest
from pyspark.sql import functions as F
from quaywise.session import read
from quaywise.sources.stores import Store
from quaywise.streaming import events as streams

DATA = "/root/testdata/sf0.001"
SCHEMA = "id long, qty double, note string, month string"


def store(folder):
    return Store(str(folder / "facts"), SCHEMA, "month", ("id", "month"), ("qty",))


def rows(spark, some):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(some)], f"{SCHEMA}, seq long")


def parts(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in (folder / "facts").rglob("*.parquet")}


def table(spark, s):
    return sorted((tuple(r) for r in s.table(spark).collect()), key=repr)


def test_loads_write_only_what_they_touch(spark, tmp_path):
    s = store(tmp_path)
    assert table(spark, s) == [] and not s.loaded(spark, "a")
    assert s.load(rows(spark, [(1, 1.0, "x", "2024-01"), (2, 2.0, "y", "2024-02"), (1, 5.0, "z", "2024-01"), (None, 3.0, "n", "2024-02"), (4, 4.0, "m", None)]), "a") == 3
    first = [(1, 5.0, "x", "2024-01"), (2, 2.0, "y", "2024-02"), (4, 4.0, "m", None), (None, 3.0, "n", "2024-02")]
    assert table(spark, s) == sorted(first, key=repr)
    before = parts(tmp_path)
    assert s.load(rows(spark, [(2, 9.0, "new", "2024-02"), (7, 7.0, "w", "2024-03")]), "b") == 2
    after = parts(tmp_path)
    same = {p for p in before if "month=2024-02" not in p}
    assert same and {p: before[p] for p in same} == {p: after[p] for p in same} and not {p for p in before if "month=2024-02" in p} & after.keys()
    assert table(spark, s) == sorted([(1, 5.0, "x", "2024-01"), (2, 9.0, "y", "2024-02"), (4, 4.0, "m", None), (None, 3.0, "n", "2024-02"), (7, 7.0, "w", "2024-03")], key=repr)
    assert s.load(rows(spark, [(1, 0.0, "q", "2024-01")]), "a") == 0 and parts(tmp_path) == after  # loaded before
    assert s.load(rows(spark, []), "empty") == 0 and s.loaded(spark, "empty") and parts(tmp_path) == after
    assert sorted(map(tuple, s.manifest(spark).collect())) == [("a", 5, 3), ("b", 2, 2), ("empty", 0, 0)]


def test_a_failed_load_changes_nothing(spark, tmp_path):
    s = store(tmp_path)
    s.load(rows(spark, [(i, 1.0, "x", f"2024-0{1 + i % 3}") for i in range(30)]), "a")
    before, held = parts(tmp_path), table(spark, s)
    bad = rows(spark, [(i, 2.0, "y", f"2024-0{1 + i % 3}") for i in range(30)]).withColumn("qty", F.when(F.col("id") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("qty")))
    with pytest.raises(Exception, match="broken"):
        s.load(bad, "b")
    assert parts(tmp_path) == before and table(spark, s) == held and not s.loaded(spark, "b")
    assert s.load(rows(spark, [(3, 2.0, "y", "2024-01")]), "b") == 1 and len(table(spark, s)) == 30


def test_a_load_without_its_row_in_the_manifest_comes_again(spark, tmp_path):
    s = store(tmp_path)
    new = rows(spark, [(1, 1.0, "x", "2024-01"), (1, 2.0, "y", "2024-01")])
    s.load(new, "a")
    held = table(spark, s)
    for p in Path(f"{s.path}.loads").glob("*"):
        p.unlink()
    assert not s.loaded(spark, "a") and s.load(new, "a") == 1 and table(spark, s) == held


def test_replace(spark, tmp_path):
    s = store(tmp_path)
    s.load(rows(spark, [(1, 1.0, "x", "2024-01"), (2, 1.0, "x", "2024-02")]), "a")
    s.replace(rows(spark, [(3, 1.0, "z", "2024-03"), (3, 4.0, "z", "2024-03")]), "b")
    assert table(spark, s) == [(3, 4.0, "z", "2024-03")] and [tuple(r) for r in s.manifest(spark).collect()] == [("b", 2, 1)]


def test_a_stream_gives_the_table_of_its_batches_also_after_a_restart(spark, tmp_path):
    events = read(spark, DATA, "events")
    folder = tmp_path / "in"
    for k in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == k).coalesce(1).write.parquet(str(folder / f"part{k}"))
    s = Store(str(tmp_path / "facts"), "event_id long, user_id long, event_type string, value double, day date", "day", ("event_id", "day"), ("value",))
    frame = lambda df: df.select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"), F.col("event_id").alias("seq"))

    def run(k):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / f"part[0-{k}]"))
        s.fed_by(frame(stream), str(tmp_path / "progress"), "events").trigger(availableNow=True).start().awaitTermination(120)

    run(1)
    half = s.table(spark).count()
    assert half == events.where("event_id % 3 < 2").count()
    run(2)  # started again, with more files there
    run(2)
    want = sorted(map(tuple, frame(events).drop("seq").collect()))
    assert sorted(map(tuple, s.table(spark).collect())) == want
    assert s.manifest(spark).where("rows > 0").count() == 3
    assert streams.daily(events, None).agg(F.sum("n")).first()[0] == len(want)
