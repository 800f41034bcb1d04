"""Streams of files against the same rows as a batch."""

import datetime

from pyspark.sql import functions as F
from tallyframe.streaming import live

KIND = "ts timestamp, z double, y int"


def _rows(n):
    at = datetime.datetime(2024, 1, 1)
    return [(at + datetime.timedelta(minutes=7 * i), (i % 13 - 6) / 3, i % 2) for i in range(n)]


def test_answers_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    batch = spark.createDataFrame(_rows(500), KIND)
    batch.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.decide_stream(stream, "z", 2.0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("ts", F.round("p", 9)).collect()))
    assert got == sorted(map(tuple, live.decide_stream(batch, "z", 2.0).select("ts", F.round("p", 9)).collect())) and len(got) == 500


def test_windows_of_a_stream_take_late_rows_up_to_the_watermark(spark, tmp_path):
    rows = _rows(400)
    stream_dir = tmp_path / "in"
    spark.createDataFrame(rows[100:], KIND).coalesce(1).write.parquet(str(stream_dir / "a"))
    stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(str(stream_dir))
    rates = live.windowed_rates(live.decide_stream(stream, "z"), "ts", "p", "y")

    def go():
        q = rates.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None

    go()
    before = spark.read.parquet(str(tmp_path / "out")).count()
    # rows from before the watermark are too late; a row far ahead closes the windows
    end = rows[-1][0] + datetime.timedelta(days=2)
    spark.createDataFrame([*rows[:100], (end, 0.0, 1)], KIND).coalesce(1).write.parquet(str(stream_dir / "b"))
    go()
    got = {r.start: r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = live.windowed_rates(live.decide_stream(spark.createDataFrame(rows[100:], KIND), "z"), "ts", "p", "y")
    want = {r.start: r.n for r in batch.collect()}
    assert 0 < before <= len(got) and got == want
