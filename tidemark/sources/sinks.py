"""Documents of jobs, and writers for them: a folder for each job, as job_id=<id>, with its JSON in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.store import stored
from tidemark.operators import boundaries, segments, timeline
from tidemark.operators.manifest import NO_IMAGE
from tidemark.sources import image_tree

VERSION = 1


def write_documents(documents: DataFrame, folder: str) -> None:
    """One JSON document a job (its row), in place of that job's last one; those of other jobs stay."""
    documents.repartition("job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").json(folder, ignoreNullFields=False)


def write_images(placed: DataFrame, folder: str) -> None:
    """The images (data) of placed() screens as files <job_id>/<label>/<number>.jpg; those of other jobs stay."""
    image_tree.write(placed.where(~F.col("label").isin(*NO_IMAGE)), folder)


def _listed(order: str, *columns: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__at"), F.struct(*columns).alias("x")))), lambda r: r["x"])


def timeline_documents(frames: DataFrame, fps: int) -> DataFrame:
    """frames with job_id, idx, status and source: counts, the strategy of times, and the items."""
    counts = timeline.summary(frames)
    items = frames.groupBy("job_id").agg(_listed("idx", *[c for c in frames.columns if c != "job_id"]).alias("items"))
    summary = F.struct(F.col("n_frames").alias("total_items"), F.col("n_final").alias("final_count"), F.col("n_removed").alias("removed_count"), F.col("strategy").alias("timestamp_strategy"))
    return counts.join(items, "job_id").select("job_id", F.lit(VERSION).alias("version"), F.col("n_frames").alias("frame_count"), F.col("n_final").alias("final_count"), F.lit(fps).alias("fps"), summary.alias("summary"), "items")


def segment_documents(frames: DataFrame, config: segments.SegmentConfig) -> DataFrame:
    """The segments of each job with their representatives, and what is odd about the first."""
    reps = segments.representatives(frames, config).select("job_id", "seg", F.col("frame_id").alias("representative_frame_id"), F.col("idx").alias("representative_index"), F.col("ts_ms").alias("representative_timestamp_ms"))
    rolled = segments.roll_up(frames, config).join(reps, ["job_id", "seg"])
    shown = ["segment_id", "start_index", "end_index", "start_ms", "end_ms", "duration_ms", "n_frames", "segment_type", "frame_ids", "representative_frame_id", "representative_index", "representative_timestamp_ms"]
    listed = rolled.groupBy("job_id").agg(F.count("*").alias("segment_count"), F.count("representative_frame_id").alias("representative_count"), _listed("seg", *shown).alias("segments"))
    settings = F.struct(F.lit(config.short_ms).alias("min_segment_duration_ms"), F.lit(config.guard_ms).alias("edge_guard_ms"), F.lit(config.gap_ms).alias("max_gap_ms"))
    return listed.join(segments.warnings(frames, config), "job_id", "left").withColumns({"version": F.lit(VERSION), "config": settings})


def boundary_documents(frames: DataFrame, config: segments.SegmentConfig, bounds: boundaries.BoundaryConfig, zones: DataFrame | None = None) -> DataFrame:
    """The summary of each job and its boundaries with what became of their candidates."""
    found = boundaries.analyse(frames, config, bounds, zones)
    report = stored(boundaries.report_of(found, bounds))
    listed = report.groupBy("job_id").agg(_listed("bnd", *[c for c in report.columns if c not in ("job_id", "bnd")]).alias("boundaries"))
    return boundaries.summary_of(found, bounds, report).join(listed, "job_id", "left").withColumn("version", F.lit(VERSION))


#: The parts of an analysis that a session profile takes over.
ANALYSIS = ("strategy_coherence", "competitive_tier", "monetization_hypothesis", "onboarding_hypothesis", "feature_strategy_reasoning")


def session_documents(profiles: DataFrame, analyses: DataFrame) -> DataFrame:
    """Profiles (see manifest.funnel) of the jobs that have an analysis, with its texts."""
    return profiles.join(analyses.select("job_id", *ANALYSIS), "job_id").withColumnRenamed("sequence", "funnel_sequence")


def manifest_documents(trees: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """Manifests (see manifest.tree), with the analysis of the job if there is one."""
    if analyses is None:
        return trees
    return trees.join(analyses.select("job_id", F.struct(*[c for c in analyses.columns if c != "job_id"]).alias("analysis")), "job_id", "left")


def classification_debug(screens: DataFrame) -> DataFrame:
    """Per job: frames, fallbacks, frames to review, and the warnings by frame, of screens with idx, needs_review, review_reason and warnings."""
    warned = F.when(F.size("warnings") > 0, F.struct("idx", "warnings"))
    return screens.groupBy("job_id").agg(
        F.count("*").alias("frame_count"),
        F.count_if(F.coalesce(F.contains("review_reason", F.lit("classification_fallback")), F.lit(False))).alias("fallback_used_count"),
        F.count_if(F.coalesce("needs_review", F.lit(False)) | (F.size("warnings") > 0)).alias("needs_review_count"),
        F.map_from_entries(F.array_sort(F.collect_list(warned))).alias("validation_warnings_by_frame"),
    )
