"""Filters for frames caught in the middle of a change.

Rules look at the distances to the frames around. Two of them (slides and fades) hold only where the
frame before was kept, so a verdict depends on the one before it; as each such frame just turns the
verdict over, it follows from the distance to the last frame whose verdict is its own, by windows alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import hamming
from tidemark.functions.pixels import fade_error


@dataclass(frozen=True)
class StabilityConfig:
    #: Distances above which both neighbours are other screens, and above which halves are two screens.
    change: int = 18
    split: int = 18
    #: A split frame needs more than this to both neighbours.
    still: int = 4
    #: Large and small distances around the two frames of a change.
    large: int = 12
    small: int = 8
    #: Slides and fades need more than `blend` to both neighbours; halves of a slide match within `slide`.
    blend: int = 5
    slide: int = 8
    fade: float = 0.12
    #: Left edges differ by more than `edge` from a next frame within `edge_next`.
    edge_next: int = 10
    edge: int = 12


def _by():
    return Window.partitionBy("job_id").orderBy("idx")


def neighbours(frames: DataFrame) -> DataFrame:
    """Adds pos (from 0), n, prev, next, prev2 (of the frame before) and next2: distances of signatures."""
    by, sig = _by(), F.col("sig")
    d = lambda n: hamming(sig, F.lag("sig", n).over(by)) if n > 0 else hamming(sig, F.lead("sig", -n).over(by))
    stepped = frames.withColumns({"prev": d(1), "next": d(-1), "n": F.count("*").over(Window.partitionBy("job_id")), "pos": F.row_number().over(by) - 1})
    return stepped.withColumns({"prev2": F.lag("prev").over(by), "next2": F.lead("next").over(by)})


def is_split(splits: Column, threshold: int) -> Column:
    """Whether the parts left and right of some cut (array of left, right) look like two screens."""
    return F.exists(splits, lambda x: hamming(x["left"], x["right"]) > threshold)


def with_fades(frames: DataFrame) -> DataFrame:
    """Adds fade_error: how far a frame's thumb is from the nearest blend of the thumbs around it; null at the ends."""
    by = _by()
    return frames.withColumn("fade_error", fade_error(F.col("thumb"), F.lag("thumb").over(by), F.lead("thumb").over(by)))


def verdicts(frames: DataFrame, config: StabilityConfig) -> DataFrame:
    """Adds rule: the first rule that drops a frame, or null.

    frames have job_id, idx, sig, is_split, left_hash, right_hash, edge_hash and fade_error.
    """
    by, c = _by(), config
    prev, following, split = F.col("prev"), F.col("next"), F.col("is_split")
    inner, last = (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1), (F.col("pos") == F.col("n") - 1) & (F.col("pos") > 0)
    base = (
        F.when(last & split, "last_split")
        .when(~inner, None)
        .when((prev > c.change) & (following > c.change), "between_changes")
        .when((F.least(prev, following) > c.still) & split, "split")
        .when((prev > c.large) & (following <= c.small) & (F.col("next2") > c.large) & split, "late")
        .when((prev <= c.small) & (following > c.large) & (F.col("prev2") > c.large) & split, "early")
    )
    moving = inner & (prev > c.blend) & (following > c.blend)
    slide = (hamming(F.col("left_hash"), F.lag("right_hash").over(by)) <= c.slide) & (hamming(F.col("right_hash"), F.lead("left_hash").over(by)) <= c.slide)
    yes = lambda x: F.coalesce(x, F.lit(False))
    signs = neighbours(frames).withColumns({
        "__base": base,
        "__blend": F.when(moving & yes(slide), "slide").when(moving & yes(F.col("fade_error") < c.fade), "fade"),
        "__edge": inner & yes(following <= c.edge_next) & yes(hamming(F.col("edge_hash"), F.lead("edge_hash").over(by)) > c.edge),
    })
    own = F.col("__base").isNotNull() | F.col("__edge")
    # A verdict of its own: every frame but one that only a slide or a fade would drop.
    fixed = F.last(F.when(own | F.col("__blend").isNull(), F.struct("pos", own.alias("dropped"))), ignorenulls=True).over(by)
    dropped = fixed["dropped"] != ((F.col("pos") - fixed["pos"]) % 2 == 1)
    settled = signs.withColumn("__dropped", dropped)
    after_kept = ~F.coalesce(F.lag("__dropped").over(by), F.lit(False))
    rule = F.coalesce("__base", F.when(after_kept, F.col("__blend")), F.when(F.col("__edge"), F.lit("edge")))
    return settled.withColumn("rule", rule).drop("__base", "__blend", "__edge", "__dropped")


def diffs(frames: DataFrame) -> DataFrame:
    """The distances around each frame for a debug report: -1 where there is no neighbour."""
    none = lambda c: F.coalesce(c, F.lit(-1))
    return neighbours(frames).select("job_id", "idx", "frame_id", none("prev").alias("prev"), none("next").alias("next"), hamming(F.col("left_hash"), F.col("right_hash")).alias("sides"))


def scout(frames: DataFrame, change: int) -> DataFrame:
    """Frames (with in_zone) that stay: those in a zone, and those that are like a neighbour."""
    return neighbours(frames).where(~(~F.col("in_zone") & (F.coalesce("prev", F.lit(-1)) > change) & (F.coalesce("next", F.lit(-1)) > change)))


def trim_tail(frames: DataFrame, moving: int) -> DataFrame:
    """Cuts the frames at the end that still move; the first frame stays, and jobs of one or two frames stay whole."""
    calm = F.max(F.when(F.col("prev") <= moving, F.col("idx"))).over(Window.partitionBy("job_id"))
    first = F.min("idx").over(Window.partitionBy("job_id"))
    return neighbours(frames).withColumn("__last", F.coalesce(calm, first)).where((F.col("n") < 3) | (F.col("idx") <= F.col("__last"))).drop("__last")


def not_blank(frames: DataFrame, mean: str = "mean") -> DataFrame:
    return frames.where(F.col(mean).between(15, 240))
