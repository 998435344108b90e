"""Two passes over a recording: a sparse one everywhere, a dense one where something moves, merged in one order.

Which frame a dense pass takes for a time is a match of two series: frames and wanted times of a job are put
in one order of time, and each time looks at the last frame before it and the first one after it. So nothing
grows with frames times wanted times. Frames, zones and what is merged of them are stored where steps fork from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.store import stored
from tidemark.operators import dedup, motion, stability, timeline
from tidemark.operators.motion import MotionConfig


def nearest(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """wanted (job_id, ts_ms, ...) with `frame`: the row of frames (job_id, frame_id, ts_ms, ...) of the job that is nearest in time, null if there is none.

    Of two equally near frames the earlier is taken, of frames of one time the least frame_id. Frames and
    wanted rows without a time match nothing.
    """
    row = F.struct(F.col("ts_ms").alias("at"), F.col("frame_id").alias("id"), F.struct(*frames.columns).alias("row"))
    # Of one time the least id.
    one = frames.where("ts_ms is not null").groupBy("job_id", "ts_ms").agg(F.min_by(row, "frame_id").alias("there"))
    asked = wanted.select("job_id", F.col("ts_ms").alias("__at"), F.struct(*wanted.columns).alias("__asked"))
    both = asked.unionByName(one.select("job_id", F.col("ts_ms").alias("__at"), "there"), allowMissingColumns=True)
    # Both ways the frame of a window only grows: one that ends with the job is gone through again for each row.
    nearby = lambda order: F.last("there", ignorenulls=True).over(Window.partitionBy("job_id").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before, after = nearby(F.asc("__at")), nearby(F.desc("__at"))
    met = both.withColumns({"__before": before, "__after": after}).where("__asked is not null")
    earlier = F.col("__after").isNull() | (F.col("__at") - F.col("__before.at") <= F.col("__after.at") - F.col("__at"))
    frame = F.when(F.col("__at").isNull(), None).when(F.col("__before").isNotNull() & earlier, F.col("__before.row")).otherwise(F.col("__after.row"))
    return met.select("__asked.*", frame.alias("frame"))


def dense_frames(zones: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames that a dense pass takes of each zone: job_id, zone_id, path, ts_ms and `frame`; times without any frame give none."""
    found = nearest(motion.dense_times(zones), frames).where("frame is not null")
    return found.select("job_id", "zone_id", F.col("name").alias("path"), "ts_ms", "frame")


def merged(scout: DataFrame, dense: DataFrame) -> DataFrame:
    """Rows of both (job_id, path, ts_ms, sig), each path of a job once (the dense one if both have it), numbered by (ts_ms, path); a missing time counts as 0."""
    both = dense.withColumn("__rank", F.lit(0)).unionByName(scout.withColumn("__rank", F.lit(1)))
    # Windows by job and path, and by job, share the exchange by job.
    once = both.repartition("job_id").withColumn("__n", F.row_number().over(Window.partitionBy("job_id", "path").orderBy("__rank", "ts_ms"))).where("__n = 1").drop("__n", "__rank")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.coalesce("ts_ms", F.lit(0)), "path"))
    return once.withColumn("idx", place.cast("long") - 1)


def scouted(frames: DataFrame, zones: DataFrame, change: int, near: int) -> DataFrame:
    """The sparse frames that stay: those in zones as they are, of the others the stable ones that differ from the last one kept."""
    still = stored(stability.scout(motion.zone_flags(frames, zones), change).select(*frames.columns, "in_zone"))
    return still.join(dedup.consecutive_with_zones(still, near), ["job_id", "idx"], "left_semi").drop("in_zone")


def unlike(both: DataFrame, near: int) -> DataFrame:
    """The rows of merged() without near duplicates."""
    # Counted, walked through and joined.
    both = stored(both)
    return both.join(dedup.leaders(both, near), ["job_id", "idx"], "left_semi")


def extract(frames: DataFrame, source: DataFrame, config: MotionConfig, change: int, near: int) -> tuple[DataFrame, DataFrame]:
    """frames (job_id, frame_id, idx, path, sig at config.fps) and a source (job_id, frame_id, ts_ms, sig at any rate): the merged frames without near duplicates, and the zones."""
    frames = stored(frames)
    zones = stored(motion.zones(motion.series(frames), config))
    kept = scouted(frames, zones, change, near)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    scout = kept.select("job_id", "path", timeline.time_of_name(name, config.fps).alias("ts_ms"), "sig")
    dense = dense_frames(zones, source).select("job_id", "path", "ts_ms", F.col("frame.sig").alias("sig"))
    return unlike(merged(scout, dense), near), zones
