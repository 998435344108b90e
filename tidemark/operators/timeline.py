"""Timelines: numbered frames, their times, and the state they end in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(frames: DataFrame, job: str, *order: str) -> DataFrame:
    """idx from 0 within each job, by the given total order."""
    return frames.withColumn("idx", F.row_number().over(Window.partitionBy(job).orderBy(*order)).cast("long") - 1)


def time_of_name(name: Column, fps: int) -> Column:
    """Milliseconds of a numbered frame file; null where the name has no number or the rate is no rate."""
    if fps <= 0:
        return F.lit(None).cast("long")
    number = F.regexp_extract(name, r"(?i)frame_(\d+)\.jpg$", 1)
    return F.when(number != "", F.floor((number.cast("long") - 1) * 1000 / fps).cast("long"))


def frame_id(path: Column) -> Column:
    """The file name without folder and ending."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def override_times(frames: DataFrame, known: DataFrame) -> DataFrame:
    """frames (with ts_ms) and a table (job_id, frame_id, known_ms) whose times win; `source` says which held."""
    joined = frames.join(known, ["job_id", "frame_id"], "left")
    source = F.when(F.col("known_ms").isNotNull(), "map").when(F.col("ts_ms").isNotNull(), "filename").otherwise("unknown")
    return joined.withColumn("source", source).withColumn("ts_ms", F.coalesce("known_ms", "ts_ms")).drop("known_ms")


def summary(frames: DataFrame) -> DataFrame:
    """Per job: frames, final and removed ones, and one word for where their times come from."""
    return frames.groupBy("job_id").agg(
        F.count("*").alias("n_frames"),
        F.count_if(F.col("status") == "final").alias("n_final"),
        F.count_if(F.col("status") == "removed").alias("n_removed"),
        F.when(F.min("source") == F.max("source"), F.min("source")).otherwise("mixed").alias("strategy"),
    )


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left outer join with the first matching row of the right side only."""
    one = right.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n", order)
    return left.join(one, keys, "left")


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the same place in their job, as far as both sides reach; columns of both."""
    return left.join(right, ["job_id", "idx"])


def all_paths(first: DataFrame, more: DataFrame) -> DataFrame:
    """The paths of either side, once each."""
    return first.select("job_id", "path").union(more.select("job_id", "path")).distinct()


#: The columns of a timeline, and those that some steps add to frames.
COLUMNS = {
    "frame_id": "string", "index": "long", "timestamp_ms": "long", "path": "string", "filename": "string", "source": "string", "status": "string", "keep_reason": "string", "remove_reason": "string",
    "is_final": "boolean", "is_blank_removed": "boolean", "is_duplicate_removed": "boolean", "label": "string", "screen_type": "string", "motion_score_prev": "double", "motion_score_next": "double",
    "sharpness_score": "double", "brightness_score": "double", "contrast_score": "double", "segment_id": "string",
}
EXTRA = {
    "timestamp_source": "string", "segment_type": "string", "representative_for_segment": "string", "transition_contamination_score": "double", "is_transition_contaminated": "boolean",
    "contamination_reason": "string", "needs_review": "boolean", "review_reason": "string", "boundary_recovery": "boolean", "boundary_id": "string", "replaced_representative_id": "string",
}


def items(frames: DataFrame) -> DataFrame:
    """job_id and a timeline's columns of frames (job_id, frame_id, idx, ts_ms and, if known, path, source of times, motion, sharpness, brightness and contrast): all candidates."""
    given = {"index": "idx", "timestamp_ms": "ts_ms", "timestamp_source": "source", "motion_score_prev": "motion_prev", "motion_score_next": "motion_next", "sharpness_score": "sharpness", "brightness_score": "brightness", "contrast_score": "contrast"}
    path = F.col("path") if "path" in frames.columns else F.col("frame_id").cast("string")
    fixed = {"path": path, "filename": F.regexp_extract(path, r"([^/]*)$", 1), "source": F.lit("extracted"), "status": F.lit("candidate"), "frame_id": F.col("frame_id")}
    fixed |= {c: F.lit(False) for c in ("is_final", "is_blank_removed", "is_duplicate_removed")}
    value = lambda c: fixed[c] if c in fixed else F.col(given[c]) if given.get(c) in frames.columns else F.lit(None)
    return frames.select("job_id", *[value(c).cast(t).alias(c) for c, t in (COLUMNS | EXTRA).items()])


def apply_changes(base: DataFrame, changed: DataFrame) -> DataFrame:
    """base with what changes say of its rows by (job_id, frame_id); of several that say something of a column the one of the last stage holds.

    A change has a stage and, for the columns that it sets, struct(value): a null struct leaves a column as it is,
    a struct of null clears it. One aggregation brings them together, and one join to the frames.
    """
    names = [c for c in changed.columns if c not in ("job_id", "frame_id", "stage")]
    last = changed.groupBy("job_id", F.col("frame_id").cast("string").alias("frame_id")).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("stage"))).alias(f"__{c}") for c in names])
    joined = base.join(last, ["job_id", "frame_id"], "left")
    return joined.withColumns({c: F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}")["value"].cast(base.schema[c].dataType)).otherwise(F.col(c)) for c in names}).drop(*[f"__{c}" for c in names])


def with_classes(frames: DataFrame, screens: DataFrame, duplicate: str, contaminated: str) -> DataFrame:
    """Timeline items after classification: final ones get label and screen type of the first screen of their path, and go if there is none.

    Contaminated ones that are not final, and have no other reason, were removed as such.
    """
    one = screens.withColumn("__n", F.row_number().over(Window.partitionBy("job_id", "path").orderBy("idx"))).where("__n = 1")
    typed = F.when(F.coalesce("screen_type", F.lit("")) != "", F.col("screen_type")).otherwise(F.split("label", "/", 2)[0])
    told = one.select("job_id", "path", F.lit(True).alias("__told"), F.col("label").cast("string").alias("__label"), typed.cast("string").alias("__type"))
    joined = frames.join(told, ["job_id", "path"], "left")
    final, known = F.col("is_final") | (F.col("status") == "final"), F.col("__told").isNotNull()
    gone, marked = final & ~known, ~F.col("is_final") & F.coalesce("is_transition_contaminated", F.lit(False))
    return joined.withColumns({
        "label": F.when(final & known, F.coalesce("__label", "label")).otherwise(F.col("label")),
        "screen_type": F.when(final & known, F.coalesce("__type", "screen_type")).otherwise(F.col("screen_type")),
        "status": F.when(gone, "removed").otherwise(F.col("status")),
        "is_final": F.col("is_final") & ~gone,
        "is_duplicate_removed": F.col("is_duplicate_removed") | gone,
        "keep_reason": F.when(gone, None).otherwise(F.col("keep_reason")),
        "remove_reason": F.when(gone, duplicate).when(marked, F.coalesce("remove_reason", F.lit(contaminated))).otherwise(F.col("remove_reason")),
    }).drop("__told", "__label", "__type")
