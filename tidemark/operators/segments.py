"""Segments: frames in a row without a large gap in time, and one representative of each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import ordinal_id


@dataclass(frozen=True)
class SegmentConfig:
    gap_ms: int = 500
    guard_ms: int = 150
    short_ms: int = 250


def assign(frames: DataFrame, config: SegmentConfig) -> DataFrame:
    """Adds seg from 1. One frame without time makes every frame of its job a segment of its own."""
    by = Window.partitionBy("job_id").orderBy("idx")
    timed = F.min(F.col("ts_ms").isNotNull()).over(Window.partitionBy("job_id"))
    new = F.when(timed & (F.col("ts_ms") - F.lag("ts_ms").over(by) <= config.gap_ms), 0).otherwise(1)
    return frames.withColumns({"__new": new, "__timed": timed}).withColumn("seg", F.sum("__new").over(by)).drop("__new")


def roll_up(frames: DataFrame, config: SegmentConfig) -> DataFrame:
    """One row a segment: bounds, length, number of frames, type."""
    start, end = (F.when(F.bool_and("__timed"), f("ts_ms")) for f in (F.min, F.max))
    rolled = assign(frames, config).groupBy("job_id", "seg").agg(F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), start.alias("start_ms"), end.alias("end_ms"), F.count("*").alias("n_frames"), F.array_sort(F.collect_list(F.struct("idx", "frame_id"))).alias("frames"))
    length = F.col("end_ms") - F.col("start_ms")
    kind = F.when(F.col("n_frames") == 1, "single_frame").when(length.isNull(), "uncertain").when(length < config.short_ms, "short_stable").otherwise("stable")
    return rolled.withColumns({"segment_id": ordinal_id("segment", F.col("seg")), "duration_ms": length, "segment_type": kind, "frame_ids": F.col("frames.frame_id")}).drop("frames")


def described(frames: DataFrame, config: SegmentConfig) -> DataFrame:
    """assign() with what each frame's segment is: bounds, frames, type, and whether the frame is its representative.

    The representative is the frame nearest to the middle, away from the ends where there is such a frame.
    All of it is windows over the job's one exchange.
    """
    seg = Window.partitionBy("job_id", "seg")
    bound = lambda f, c: F.when(F.col("__timed"), f(c).over(seg))
    staged = assign(frames, config).withColumns({
        "start_index": F.min("idx").over(seg), "end_index": F.max("idx").over(seg), "start_ms": bound(F.min, "ts_ms"), "end_ms": bound(F.max, "ts_ms"),
        "n_frames": F.count("*").over(seg), "__pos": F.row_number().over(seg.orderBy("idx")),
    })
    length = F.col("end_ms") - F.col("start_ms")
    kind = F.when(F.col("n_frames") == 1, "single_frame").when(length.isNull(), "uncertain").when(length < config.short_ms, "short_stable").otherwise("stable")
    inner = F.when(F.col("ts_ms").between(F.col("start_ms") + config.guard_ms, F.col("end_ms") - config.guard_ms), 1).otherwise(0)
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    # Without times: the middle one of those that are not at an end, or of two the second.
    slot = F.when(F.col("n_frames") >= 3, F.floor((F.col("n_frames") - 2) / 2) + 2).otherwise(F.floor(F.col("n_frames") / 2) + 1)
    far = F.when(middle.isNull(), F.abs(F.col("__pos") - slot)).otherwise(F.coalesce(F.abs(F.col("ts_ms") - middle), F.lit(0))).cast("long")
    ranked = staged.withColumns({"segment_type": kind, "__inner": inner, "__far": far}).withColumn("__any", F.max("__inner").over(seg))
    at_end = (F.col("__pos") == 1) | (F.col("__pos") == F.col("n_frames"))
    tier = F.when(F.col("n_frames") == 1, 0).when(F.col("__any") == 1, 1 - F.col("__inner")).when((F.col("n_frames") >= 3) & at_end, 1).otherwise(0)
    best = F.row_number().over(seg.orderBy(tier, "__far", "idx"))
    return ranked.withColumn("is_rep", best == 1).drop("__pos", "__inner", "__far", "__any")


def representatives(frames: DataFrame, config: SegmentConfig) -> DataFrame:
    """One frame a segment (see described())."""
    chosen = described(frames, config).where("is_rep")
    return chosen.select("job_id", "seg", "frame_id", "idx", "ts_ms", F.col("start_ms").alias("st"), F.col("end_ms").alias("en"), "n_frames")


def warnings(frames: DataFrame, config: SegmentConfig) -> DataFrame:
    """Per job: whether the first representative comes late, and whether the first segment is short."""
    first = representatives(frames, config).where("seg = 1")
    begin = frames.groupBy("job_id").agg(F.min("ts_ms").alias("begin_ms"))
    late = F.col("ts_ms") - F.col("begin_ms") > 2 * config.guard_ms
    short = F.col("en") - F.col("st") < config.short_ms
    return first.join(begin, "job_id").select("job_id", F.coalesce(late, F.lit(False)).alias("late_start"), F.coalesce(short & (F.col("n_frames") > 1), F.lit(False)).alias("short_first"))
