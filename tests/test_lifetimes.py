import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from quaywise.session import read
from quaywise.streaming import lifetimes

DATA = "/root/testdata/sf0.001"
HOURS = 6 * 3600
START = datetime.datetime(2024, 1, 1)


def plain(signs, seconds):
    """Stretches of (key, minute, value), one sign after the other."""
    out, gap = [], seconds // 60
    for key in {s[0] for s in signs}:
        open_ = None
        for _, m, v in sorted((s for s in signs if s[0] == key and s[1] is not None), key=lambda s: (s[1], s[2] is not None, s[2] or "")):
            if open_ and m < open_[1] + gap:
                open_ = (open_[0], m, open_[2] + 1, v)
            else:
                out += [(key, *open_)] if open_ else []
                open_ = (m, m, 1, v)
        out += [(key, *open_)] if open_ else []
    return out


def minutes(rows):
    at = lambda t: int((t.replace(tzinfo=None) - START).total_seconds() // 60)
    return sorted(((r[0], at(r.first_at), at(r.last_at), r.n, r.value) for r in rows), key=repr)


SIGNS = [
    ("a", 0, "x"), ("a", 10, "y"), ("a", 25, "z"), ("a", 40, "at the very end"), ("a", 54, None), ("a", 54, "tie"), ("a", 54, "a tie"),
    ("b", 5, None), ("b", 200, "é"), ("b", 200, "z"), (None, 1, "n"), (None, 2, "m"), ("c", None, "no time"), ("d", 3, "same"), ("d", 3, "same"),
]


def frame(spark, signs):
    return spark.createDataFrame([(k, None if m is None else START + datetime.timedelta(minutes=m), v) for k, m, v in signs], "k string, ts timestamp, v string")


def test_table(spark):
    got = minutes(lifetimes.of_table(frame(spark, SIGNS), ["k"], "ts", F.col("v"), 900).collect())
    assert got == sorted(plain(SIGNS, 900), key=repr)
    assert lifetimes.of_table(frame(spark, []), ["k"], "ts", F.col("v"), 900).count() == 0


def test_joined():
    assert lifetimes.joined([], 5) == []
    assert lifetimes.joined([(0, 0, 1, "a"), (4, 4, 1, "b"), (9, 9, 1, "c")], 5) == [(0, 4, 2, "b"), (9, 9, 1, "c")]
    assert lifetimes.joined([(0, 3, 2, "a"), (9, 12, 2, "c"), (6, 6, 1, None)], 5) == [(0, 12, 5, "c")]  # a late one joins two
    assert lifetimes.joined([(1, 1, 1, None), (1, 1, 1, "v")], 5) == [(1, 1, 2, "v")]


def run(spark, stream, folder, late="1 day", keys=("k",), time="ts", value="v", seconds=900):
    found = lifetimes.of_stream(stream, list(keys), time, F.col(value), seconds, late)
    found.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination(200)
    return spark.read.parquet(str(folder / "out"))


def test_stream_over_batches_and_a_restart(spark, tmp_path):
    """Signs come in three files, the last after a restart; one of them is late and joins two stretches."""
    parts = [SIGNS, [("a", 47, "late"), ("e", 100, "q"), ("b", 214, "renewed")], [("z", 100_000, "far ahead")]]
    stream = spark.readStream.schema("k string, ts timestamp, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    for i, part in enumerate(parts[:2]):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    assert run(spark, stream, tmp_path, "400 minutes").count() == 0  # the watermark is before every end
    frame(spark, parts[2]).coalesce(1).write.parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema("k string, ts timestamp, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = minutes(run(spark, stream, tmp_path, "400 minutes").collect())
    assert got == sorted((s for s in plain(sum(parts, []), 900) if s[0] != "z"), key=repr)
    assert minutes(run(spark, stream, tmp_path, "400 minutes").collect()) == got  # nothing twice


@pytest.mark.parametrize("cuts", [1, 4])
def test_events_as_a_stream(spark, tmp_path, cuts):
    """However the events are cut into batches in their order, the stretches that have ended are those of the table."""
    events = read(spark, DATA, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.ntile(cuts).over(Window.orderBy("ts", "event_id"))
    for i in range(cuts):
        events.withColumn("_p", part).where(F.col("_p") == i + 1).drop("_p").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = run(spark, stream, tmp_path, "1 day", ("user_id",), "ts", "event_type", HOURS)
    end = events.agg(F.max("ts")).first()[0] - datetime.timedelta(days=1)
    want = lifetimes.of_table(events, ["user_id"], "ts", F.col("event_type"), HOURS).where(F.col("expires_at") < F.lit(end))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
