"""From frames with signatures and times to the frames to show, and to manifests: the operators in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import pixels
from tidemark.operators import boundaries, dedup, manifest, motion, stability, timeline
from tidemark.operators.boundaries import BoundaryConfig
from tidemark.operators.motion import MotionConfig
from tidemark.operators.segments import SegmentConfig
from tidemark.operators.stability import StabilityConfig
from tidemark.sources.tables import image_frames


def scan(spark: SparkSession, folder: str, fps: int) -> DataFrame:
    """The image files of a folder as frames: job_id (the folder), frame_id, idx, ts_ms, and all pixel features with sig and content."""
    found = pixels.features(image_frames(spark, folder))
    numbered = timeline.number_rows(found.withColumn("job_id", F.lit(folder)), "job_id", "ordinal", "path")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return numbered.withColumns({"frame_id": timeline.frame_id(F.col("path")), "ts_ms": timeline.time_of_name(name, fps), "sig": F.col("full_hash")})


def held_frames(frames: DataFrame, config: StabilityConfig, moving: int, near: int) -> DataFrame:
    """scan() without frames in the middle of a change, the moving tail, blank frames and near duplicates."""
    judged = stability.verdicts(stability.with_fades(frames).withColumn("is_split", stability.is_split(F.col("splits"), config.split)), config)
    still = stability.not_blank(judged.where("rule is null").select(*frames.columns))
    tailed = stability.trim_tail(still, moving).select(*frames.columns)
    # Duplicates are told by what is below the status bar.
    signed = tailed.select("job_id", "idx", F.col("content_hash").alias("sig"))
    thinned = signed.join(dedup.consecutive(signed, near), ["job_id", "idx"], "left_semi")
    return tailed.join(dedup.leaders(thinned, near), ["job_id", "idx"], "left_semi")


def stable_frames(frames: DataFrame, config: MotionConfig, change: int, near: int, moving: int) -> DataFrame:
    """frames (job_id, frame_id, idx, sig): without unstable ones, near duplicates and the moving tail."""
    zones = motion.zones(motion.series(frames), config)
    scouted = stability.scout(motion.zone_flags(frames, zones), change).select("job_id", "frame_id", "idx", "sig", "in_zone")
    thinned = scouted.join(dedup.consecutive_with_zones(scouted, near), ["job_id", "idx"], "left_semi")
    unique = thinned.join(dedup.leaders(thinned, near), ["job_id", "idx"], "left_semi")
    return stability.trim_tail(unique.select("job_id", "frame_id", "idx", "sig"), moving).select("job_id", "frame_id", "idx", "sig")


def shown_frames(frames: DataFrame, segments: SegmentConfig, bounds: BoundaryConfig) -> DataFrame:
    """frames (job_id, frame_id, idx, ts_ms): representatives and what boundaries swallowed, in order."""
    return boundaries.final(frames, segments, bounds)


def outputs(screens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests and session profiles of classified screens, a row a job."""
    distinct = dedup.first_of_meaning(screens)
    return manifest.tree(distinct), manifest.funnel(distinct)
