"""Motion between neighbouring frames, and the intervals in which it is high.

All steps are windows over (job_id, idx), so one shuffle by job serves them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import hamming, ordinal_id


@dataclass(frozen=True)
class MotionConfig:
    fps: int = 6
    motion: float = 8
    anomaly: float = 12
    window: int = 3
    expand: int = 1


def _by(*more: str):
    return Window.partitionBy("job_id").orderBy("idx", *more)


def series(frames: DataFrame) -> DataFrame:
    """job_id, idx and m: the Hamming distance to the next frame, for all but the last frame."""
    return frames.select("job_id", "idx", hamming(F.col("sig"), F.lead("sig").over(_by())).alias("m")).where("m is not null")


def smooth(motion: DataFrame, config: MotionConfig) -> DataFrame:
    """Adds sm: the mean over a centred window, shorter at the ends."""
    reach = config.window // 2
    return motion.withColumn("sm", F.avg("m").over(_by().rowsBetween(-reach, reach)))


def _time(idx: Column, fps: int) -> Column:
    """Milliseconds of a frame's number; the number itself where the rate is no rate."""
    return F.floor(idx * 1000 / fps).cast("long") if fps > 0 else idx.cast("long")


_ZONE = ["job_id", "start_index", "end_index", "peak_index", "score", "kind"]


def runs(motion: DataFrame, config: MotionConfig) -> DataFrame:
    """Zones of consecutive high smoothed motion, widened; the peak is the first largest raw motion."""
    high = smooth(motion, config).where(F.col("sm") > config.motion).withColumn("island", F.col("idx") - F.row_number().over(_by()))
    return high.groupBy("job_id", "island").agg(
        F.greatest(F.min("idx") - config.expand, F.lit(0)).alias("start_index"),
        (F.max("idx") + config.expand).alias("end_index"),
        F.min_by("idx", F.struct(-F.col("m"), "idx")).alias("peak_index"),
        F.max("m").alias("score"),
        F.lit("multi").alias("kind"),
    ).select(_ZONE)


def anomalies(motion: DataFrame, config: MotionConfig) -> DataFrame:
    """Zones of single frames that differ from both neighbours."""
    before = F.lag("m").over(_by())
    hit = motion.withColumn("before", before).where((F.col("before") > config.anomaly) & (F.col("m") > config.anomaly))
    return hit.select("job_id", F.greatest(F.col("idx") - 1, F.lit(0)).alias("start_index"), (F.col("idx") + 1).alias("end_index"), F.col("idx").alias("peak_index"), F.greatest("before", "m").alias("score"), F.lit("anomaly").alias("kind"))


def zones(motion: DataFrame, config: MotionConfig) -> DataFrame:
    """Runs and anomalies with times, overlapping ones merged; zone_id by time, and the rate to sample each with."""
    found = runs(motion, config).unionByName(anomalies(motion, config)).withColumns({"start_ms": _time(F.col("start_index"), config.fps), "end_ms": _time(F.col("end_index") + 1, config.fps), "rank": F.when(F.col("kind") == "multi", 0).otherwise(1)})
    order = Window.partitionBy("job_id").orderBy("start_ms", "rank", "peak_index")
    last = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    grouped = found.withColumn("new", F.when(F.col("start_ms") - last <= 1000 // max(config.fps, 1), 0).otherwise(1)).withColumn("group", F.sum("new").over(order)).withColumn("place", F.row_number().over(order))
    merged = grouped.groupBy("job_id", "group").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.min("start_index").alias("start_index"),
        F.max("end_index").alias("end_index"),
        F.min_by("peak_index", F.struct(-F.col("score"), "place")).alias("peak_index"),
        F.max("score").alias("score"),
        F.when(F.min("rank") == 0, "multi").otherwise("anomaly").alias("kind"),
    )
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("start_ms"))
    return merged.withColumn("zone_id", ordinal_id("motion", number)).withColumn("peak_ms", _time(F.col("peak_index"), config.fps)).withColumn("dense_fps", dense_rate(F.col("start_ms"), F.col("end_ms"))).drop("group")


def dense_rate(start: Column, end: Column) -> Column:
    """Frames a second for an interval: short ones are sampled more densely."""
    length = F.greatest(end - start, F.lit(1))
    return F.when(start.isNull() | end.isNull(), 15).when(length <= 400, 30).when(length <= 1500, 15).otherwise(8)


def zone_flags(frames: DataFrame, zoned: DataFrame) -> DataFrame:
    """Adds in_zone: whether the frame's idx lies in a zone of its job.

    Frames and the starts of zones are put in one order, and the running maximum of the zones' ends tells if one is
    still open, so that it does not grow with frames times zones.
    """
    own = frames.select("job_id", F.col("idx").cast("long").alias("__at"), F.struct(*[F.col(f"`{c}`") for c in frames.columns]).alias("__row"))
    spans = zoned.where("job_id is not null and start_index is not null").select("job_id", F.col("start_index").cast("long").alias("__at"), F.col("end_index").cast("long").alias("__end"))
    # A zone that starts at a frame holds it.
    so_far = Window.partitionBy("job_id").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = own.unionByName(spans, allowMissingColumns=True).withColumn("in_zone", F.coalesce(F.max("__end").over(so_far) >= F.col("__at"), F.lit(False)))
    return met.where("__row is not null").select("__row.*", "in_zone")


def in_zone(frames: DataFrame, zoned: DataFrame, inside: bool = True) -> DataFrame:
    """The frames whose idx lies in a zone of their job, or in none."""
    return zone_flags(frames, zoned).where(F.col("in_zone") == inside).select(*[F.col(f"`{c}`") for c in frames.columns])


def dense_times(zoned: DataFrame, least_ms: int = 50) -> DataFrame:
    """(job_id, zone_id, ordinal, name, ts_ms): the frames to be taken of each zone at its dense rate, zones of no length for least_ms."""
    whole = zoned.where("start_ms is not null and end_ms is not null")
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(least_ms))
    count = F.ceil(length * F.col("dense_fps") / 1000).cast("int")
    each = whole.select("job_id", "zone_id", "start_ms", "dense_fps", F.explode(F.sequence(F.lit(1), count)).alias("ordinal"))
    ts = F.col("start_ms") + F.floor((F.col("ordinal") - 1) * 1000 / F.greatest("dense_fps", F.lit(1)))
    name = F.format_string("frame_z%s_%04d.jpg", F.replace("zone_id", F.lit("motion_"), F.lit("")), "ordinal")
    return each.select("job_id", "zone_id", F.col("ordinal").cast("long").alias("ordinal"), name.alias("name"), ts.cast("long").alias("ts_ms"))
