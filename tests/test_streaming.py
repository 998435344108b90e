"""Replayed tables give the rows of the batch operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import dedup, segments
from tidemark.operators.timeline import number_rows
from tidemark.sources.tables import hashed_frames, table, timed_frames
from tidemark.streaming import frames as stream

DATA = "/root/testdata/sf0.001"
HOUR = 3_600_000


def replay(spark, rows, order, parts, folder):
    """A stream that gets rows in the given order, a part of them at each trigger."""
    bounded = rows.withColumn("__part", F.ntile(parts).over(Window.orderBy(order)))
    for i in range(1, parts + 1):
        bounded.where(F.col("__part") == i).drop("__part").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(frame, name, mode, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return frame.sparkSession.table(name)


def test_segments_of_a_stream(spark, tmp_path):
    events = table(spark, DATA, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("frame_id"), "ts")
    rows = number_rows(events, "job_id", "ts", "frame_id")
    config = segments.SegmentConfig(gap_ms=4 * HOUR, guard_ms=HOUR // 2, short_ms=HOUR)
    # A last frame, far away, moves the watermark past all others.
    end = rows.limit(1).select(F.lit(-1).cast(rows.schema["job_id"].dataType).alias("job_id"), F.lit(-1).cast("long").alias("frame_id"), F.lit("2100-01-01").cast(rows.schema["ts"].dataType).alias("ts"), F.lit(0).cast("long").alias("idx"))
    source = replay(spark, rows.unionByName(end), "ts", 4, str(tmp_path / "in"))
    found = run(stream.segments(source.withColumn("ts", F.col("ts").cast("timestamp")), config, "1 hour"), "stream_segments", "append", tmp_path)
    expected = segments.roll_up(timed_frames(spark, DATA), config)
    columns = ["job_id", "start_index", "end_index", "start_ms", "end_ms", "n_frames", "segment_type"]
    assert sorted(tuple(r) for r in found.select(columns).collect()) == sorted(tuple(r) for r in expected.select(columns).collect())


def test_kept_frames_of_a_stream(spark, tmp_path):
    rows = hashed_frames(spark, DATA).select("job_id", "idx", "sig")
    source = replay(spark, rows, "idx", 3, str(tmp_path / "in"))
    found = run(stream.kept(source, 30), "stream_kept", "append", tmp_path)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in dedup.consecutive(rows, 30).collect())
