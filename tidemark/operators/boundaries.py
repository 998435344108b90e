"""Boundaries between states: frames near them are doubtful, and frames they swallowed are brought back.

A boundary is a motion zone or the gap between neighbouring segments. Whether a frame lies in or near
one is an as-of question: intervals and frames of a job are put in one order of time, and the running
maximum of the intervals' ends tells if one of them is still open. Frames meet the windows beside
boundaries through bins of time in the join key. So neither grows with frames times boundaries.

frames have job_id, frame_id, idx and ts_ms, and may have path, motion_prev, motion_next, sharpness,
label and screen_type; a missing one counts as null (path as frame_id).

judged() has all that the other functions ask of a frame in one table, by windows over two exchanges by
job; analyse() stores it, so that what forks from it does not scan the frames again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import ordinal_id
from tidemark.functions.store import stored
from tidemark.operators.segments import SegmentConfig, described

#: Names of issues, warnings and reasons.
SKIPPED_BEFORE = "skipped_pre_transition_state"
SKIPPED_AFTER = "skipped_post_transition_state"
ONLY_CONTAMINATED = "possible_skipped_state_only_seen_as_transition_contaminated_frame"
REPEATED = "duplicate_representative_after_boundary"
WARN_CONTAMINATED = "Skipped recovery because only candidate was transition-contaminated"
WARN_DRIFT = "adjacent_representatives_look_like_drift"
NEAR_REVIEW = "representative_near_transition_boundary"
RECOVERED_REVIEW = "possible_skipped_intermediate_state"
SHORT_REVIEW = "short_intermediate_state"
STABLE_TYPES = ("stable", "short_stable", "single_frame")
#: Points in hundredths for each sign that a frame shows two states at once, and the name of the sign.
SIGNS = (("inside_transition_zone", 35), ("near_transition_edge", 25), ("high_motion_prev", 20), ("high_motion_next", 20), ("high_motion_prev_next", 15), ("low_sharpness", 10))


@dataclass(frozen=True)
class BoundaryConfig:
    edge_ms: int = 180
    before_ms: int = 700
    after_ms: int = 700
    most: int = 2
    #: Points from which a frame is contaminated, and badly so.
    contaminated: int = 65
    hard: int = 82
    high_motion: float = 0.6
    low_sharpness: float = 0.35
    #: Neighbouring representatives within this time that say the same have drifted.
    drift_ms: int = 1200
    reject_contaminated: bool = True
    preserve_short: bool = True
    mark_recovered: bool = True


def _with(frames: DataFrame) -> DataFrame:
    """frames with all optional columns."""
    kinds = {"path": "string", "motion_prev": "double", "motion_next": "double", "sharpness": "double", "label": "string", "screen_type": "string"}
    missing = {c: (F.col("frame_id") if c == "path" else F.lit(None)).cast(t) for c, t in kinds.items() if c not in frames.columns}
    return frames.withColumns(missing) if missing else frames


def _bounds(reps: DataFrame, zones: DataFrame | None) -> DataFrame:
    """Boundaries from the representatives of described() frames, and zones."""
    by = Window.partitionBy("job_id").orderBy("seg")
    own = ["seg", "start_ms", "end_ms", "start_index", "end_index", "rep"]
    rolled = reps.withColumn("rep", F.col("frame_id"))
    pairs = rolled.select("job_id", *own, *[F.lead(c).over(by).alias(f"next_{c}") for c in own]).where("next_seg is not null")
    start, end = F.col("end_ms"), F.col("next_start_ms")
    gaps = pairs.select(
        "job_id",
        F.lit("segment_gap").alias("boundary_type"),
        start.alias("start_ms"),
        end.alias("end_ms"),
        F.when(end <= start, start).otherwise(F.floor((start + end) / 2)).cast("long").alias("peak_ms"),
        F.col("end_index").alias("start_index"),
        F.col("next_start_index").alias("end_index"),
        F.col("seg").alias("before_seg"),
        F.col("next_seg").alias("after_seg"),
        F.col("rep").alias("before_rep"),
        F.col("next_rep").alias("after_rep"),
    )
    found = gaps.withColumn("rank", F.lit(1))
    if zones is not None:
        moved = zones.select("job_id", F.coalesce("kind", F.lit("transition")).alias("boundary_type"), "start_ms", "end_ms", "peak_ms", F.lit(0).alias("rank"))
        found = moved.unionByName(found, allowMissingColumns=True)
    # Of boundaries that start together zones come first, in their order.
    order = [F.col("start_ms").isNull(), F.coalesce("start_ms", F.lit(0)), F.coalesce("start_index", F.lit(0)), "rank", F.coalesce("before_seg", F.lit(0)), "end_ms", "peak_ms"]
    number = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    return found.withColumn("bnd", number).withColumn("boundary_id", ordinal_id("boundary", F.col("bnd"))).drop("rank")


def detect(frames: DataFrame, segments: SegmentConfig, zones: DataFrame | None = None) -> DataFrame:
    """Boundaries in order of time, numbered by job: motion zones (job_id, start_ms, end_ms, peak_ms, kind) and the gaps between segments."""
    return _bounds(described(frames, segments).where("is_rep"), zones)


def _spans(start: Column, end: Column, edge_ms: int) -> Column:
    """The intervals (lo, hi, inner) in which a time lies in a boundary, or near one of its ends."""
    interval = lambda lo, hi, inner: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.lit(inner).alias("inner"))
    whole = F.array(interval(start, end, True), interval(start - edge_ms, start - 1, False), interval(end + 1, end + edge_ms, False))
    # A boundary without one of its ends, or with ends in the wrong order, holds nothing.
    broken = F.array(interval(start - edge_ms, start + edge_ms, False), interval(end - edge_ms, end + edge_ms, False))
    return F.filter(F.when(start <= end, whole).otherwise(broken), lambda x: x["lo"].isNotNull() & (x["lo"] <= x["hi"]))


def _event(at: Column, row: Column, inner_end: Column, near_end: Column) -> Column:
    """Something at a time: a frame (row), or the begin of an interval and its end."""
    return F.struct(at.alias("at"), row.alias("row"), inner_end.cast("long").alias("inner_end"), near_end.cast("long").alias("near_end"))


def _begins(spans: Column, no_row: Column) -> Column:
    return F.transform(spans, lambda x: _event(x["lo"], no_row, F.when(x["inner"], x["hi"]), F.when(~x["inner"], x["hi"])))


def _met(events: DataFrame) -> DataFrame:
    """The frames of events, with inside and near: an interval that began before is still open."""
    so_far = Window.partitionBy("job_id").orderBy("at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    still = lambda c: F.coalesce(F.max(c).over(so_far) >= F.col("at"), F.lit(False))
    return events.withColumns({"inside": still("inner_end"), "near": still("near_end")}).where("row is not null").select("row.*", "inside", "near")


def _rows_of(frames: DataFrame) -> tuple[Column, Column]:
    row = F.struct(*[F.col(f"`{c}`") for c in frames.columns])
    return row, F.when(F.lit(False), row)


def _begun(frames: DataFrame, bounds: DataFrame, edge_ms: int) -> DataFrame:
    none = F.lit(None).cast(frames.select(_rows_of(frames)[0].alias("row")).schema["row"].dataType)
    spans = bounds.select("job_id", F.explode(_begins(_spans(F.col("start_ms"), F.col("end_ms"), edge_ms), none)).alias("x"))
    return spans.select("job_id", "x.*")


def touched(frames: DataFrame, bounds: DataFrame, edge_ms: int) -> DataFrame:
    """Adds inside (some boundary of the job holds the frame's time) and near (some other one has an end within edge_ms)."""
    nothing = F.lit(None)
    own = frames.select("job_id", _event(F.col("ts_ms"), _rows_of(frames)[0], nothing, nothing).alias("x")).select("job_id", "x.*")
    return _met(own.unionByName(_begun(frames, bounds, edge_ms)))


def _touched_by_gaps(frames: DataFrame, zones: DataFrame | None, edge_ms: int) -> DataFrame:
    """touched() of described() frames by their own gaps and by zones: the last frame of a segment brings the gap after it along, so that nothing is computed twice."""
    by = Window.partitionBy("job_id").orderBy("idx")
    row, no_row = _rows_of(frames)
    nothing = F.lit(None)
    after = frames.withColumns({"__row": row, "__seg": F.lead("seg").over(by), "__start": F.lead("start_ms").over(by)})
    gap = _begins(_spans(F.col("end_ms"), F.col("__start"), edge_ms), no_row)
    own = F.array(_event(F.col("ts_ms"), F.col("__row"), nothing, nothing))
    events = after.select("job_id", F.explode(F.when((F.col("idx") == F.col("end_index")) & F.col("__seg").isNotNull(), F.concat(own, gap)).otherwise(own)).alias("x")).select("job_id", "x.*")
    return _met(events if zones is None else events.unionByName(_begun(frames, zones, edge_ms)))


def scored(frames: DataFrame, bounds: DataFrame, config: BoundaryConfig) -> DataFrame:
    """touched() with points (hundredths, at most 100), contaminated, hard and reason."""
    return _scored(touched(_with(frames), bounds, config.edge_ms), config)


def _scored(found: DataFrame, config: BoundaryConfig) -> DataFrame:
    high = [F.coalesce(F.col(c) >= config.high_motion, F.lit(False)) for c in ("motion_prev", "motion_next")]
    signs = [F.col("inside"), F.col("near"), *high, high[0] & high[1], F.coalesce(F.col("sharpness") < config.low_sharpness, F.lit(False))]
    points = F.least(reduce(Column.__add__, [F.when(c, n).otherwise(0) for c, (_, n) in zip(signs, SIGNS, strict=True)]), F.lit(100))
    named = F.array_join(F.array_compact(F.array(*[F.when(c, name) for c, (name, _) in zip(signs, SIGNS, strict=True)])), "; ")
    return found.withColumns({"points": points, "contaminated": points >= config.contaminated, "hard": points >= config.hard, "reason": F.when(named == "", "no_signal").otherwise(named)})


def candidate_class(contaminated: Column, segment_type: Column) -> Column:
    return F.when(contaminated, "likely_transition_contaminated").when(segment_type.isin(*STABLE_TYPES), "likely_stable_state").otherwise("uncertain")


@dataclass(frozen=True)
class Analysis:
    """judged() frames, and the boundaries of their jobs."""

    frames: DataFrame
    bounds: DataFrame


def judged(frames: DataFrame, segments: SegmentConfig, config: BoundaryConfig, zones: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """described() and scored() frames, with what is chosen of each segment.

    picked is a representative that was selected: all of them, or those in selected (job_id, frame_id).
    chosen is the picked one, moved away from boundaries if its segment allows; moved and review (the reason to look
    at one that had to stay) say how. free are frames that no chosen one, nor one of the same path, stands for.
    """
    based = described(_with(frames), segments)
    picked = F.col("is_rep")
    if selected is not None:
        # Before the windows, so that they keep the exchange by job.
        marked = _with(frames).join(selected.select("job_id", "frame_id", F.lit(True).alias("__handed")), ["job_id", "frame_id"], "left")
        based, picked = described(marked, segments), picked & F.coalesce("__handed", F.lit(False))
    rated = _scored(_touched_by_gaps(based, zones, config.edge_ms), config)
    seg = Window.partitionBy("job_id", "seg")
    doubtful = F.col("inside") | F.col("near")
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2)
    staged = rated.withColumns({"picked": picked, "doubtful": doubtful, "__far": F.coalesce(F.abs(F.col("ts_ms") - middle), F.lit(0)).cast("long"), "__quiet": F.coalesce("motion_prev", F.lit(0.0))})
    stays = ~F.max(F.when(F.col("picked"), F.col("doubtful"))).over(seg)
    # A safe representative itself; else the safe frame nearest to the middle; else the representative.
    tier = F.when(stays, F.when(F.col("picked"), 0).otherwise(2)).otherwise(F.when(F.col("picked"), 1).when(F.col("doubtful") | F.col("contaminated"), 2).otherwise(0))
    best = F.row_number().over(seg.orderBy("__tier", "__far", "__quiet", "idx")) == 1
    held = staged.withColumns({"__tier": tier, "__held": F.max("picked").over(seg)}).withColumn("chosen", best & F.col("__held"))
    paths = F.max("chosen").over(Window.partitionBy("job_id", "path"))
    found = held.withColumns({
        "moved": F.col("chosen") & ~F.col("picked"),
        "review": F.when(F.col("chosen") & F.col("picked") & F.col("doubtful"), NEAR_REVIEW),
        "free": ~F.col("chosen") & (F.col("path").isNull() | ~paths),
    })
    return found.drop("__far", "__quiet", "__tier", "__held", "__handed", "__timed")


def analyse(frames: DataFrame, segments: SegmentConfig, config: BoundaryConfig, zones: DataFrame | None = None, selected: DataFrame | None = None) -> Analysis:
    """judged() frames, stored, and the boundaries."""
    kept = stored(judged(frames, segments, config, zones, selected))
    return Analysis(kept, _bounds(kept.where("is_rep"), zones))


def guarded(frames: DataFrame, segments: SegmentConfig, config: BoundaryConfig, zones: DataFrame | None = None) -> DataFrame:
    """The representative of each segment, moved away from boundaries if its segment allows.

    Adds near (the chosen frame lies in or near a boundary), moved, and review, the reason to look at
    one that had to stay.
    """
    return chosen_of(judged(frames, segments, config, zones))


def chosen_of(found: DataFrame) -> DataFrame:
    return found.where("chosen").select("job_id", "seg", "frame_id", "idx", "ts_ms", "path", "label", "screen_type", F.col("doubtful").alias("near"), "moved", "review")


def candidates(frames: DataFrame, segments: SegmentConfig, config: BoundaryConfig, zones: DataFrame | None = None) -> DataFrame:
    """(job_id, bnd, frame_id, idx, ts_ms, side, class, outcome) of the frames beside boundaries that no segment chose.

    The frames before a boundary are looked at first, each side in order. outcome is recovered for the
    first `most` stable ones of different paths, contaminated or rejected for others before the last
    of these, and null for what was not looked at any more or repeats a path.
    """
    return candidates_of(analyse(frames, segments, config, zones), config)


def candidates_of(found: Analysis, config: BoundaryConfig) -> DataFrame:
    rest = found.frames.where("free").select("job_id", "frame_id", "idx", "ts_ms", "path", candidate_class(F.col("contaminated"), F.col("segment_type")).alias("class"))
    sides = F.array(
        F.struct(F.lit(0).alias("side"), (F.col("start_ms") - config.before_ms).alias("lo"), (F.col("start_ms") - config.edge_ms).alias("hi")),
        F.struct(F.lit(1).alias("side"), (F.col("end_ms") + config.edge_ms).alias("lo"), (F.col("end_ms") + config.after_ms).alias("hi")),
    )
    width = max(config.before_ms, config.after_ms) + 1
    spans = found.bounds.select("job_id", "bnd", F.explode(sides).alias("x")).select("job_id", "bnd", "x.*").where("lo <= hi")
    binned = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    met = rest.withColumn("bin", F.floor(F.col("ts_ms") / width)).join(binned, ["job_id", "bin"]).where("ts_ms between lo and hi")
    # One exchange by boundary serves all three windows.
    by, stable = Window.partitionBy("job_id", "bnd"), F.col("class") == "likely_stable_state"
    first_of_path = F.row_number().over(Window.partitionBy("job_id", "bnd", "path", "class").orderBy("side", "idx"))
    counted = met.repartition("job_id", "bnd").withColumn("new", stable & (first_of_path == 1))
    so_far = by.orderBy("side", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(F.when(F.col("new"), 1).otherwise(0)).over(so_far) - F.when(F.col("new"), 1).otherwise(0)
    # A path that has been recovered is not looked at again.
    seen = F.max(F.when(F.col("new"), F.lit(True))).over(Window.partitionBy("job_id", "bnd", "path").orderBy("side", "idx").rowsBetween(Window.unboundedPreceding, -1))
    staged = counted.withColumns({"before": before, "seen": F.coalesce(seen, F.lit(False))})
    outcome = F.when((F.col("before") >= config.most) | F.col("seen"), None).when(F.col("new"), "recovered").when(F.col("class") == "likely_transition_contaminated", "contaminated").when(~stable, "rejected")
    return staged.select("job_id", "bnd", "frame_id", "idx", "ts_ms", "side", "class", outcome.alias("outcome"))


def recovered(frames: DataFrame, segments: SegmentConfig, config: BoundaryConfig, zones: DataFrame | None = None) -> DataFrame:
    """(job_id, bnd, frame_id, idx, ts_ms, side) of the frames that are brought back."""
    return candidates(frames, segments, config, zones).where("outcome = 'recovered'").select("job_id", "bnd", "frame_id", "idx", "ts_ms", "side")


def report(frames: DataFrame, segments: SegmentConfig, config: BoundaryConfig, zones: DataFrame | None = None) -> DataFrame:
    """The boundaries with what became of their candidates: ids, issue_detected, issue_type and warnings."""
    return report_of(analyse(frames, segments, config, zones), config)


def report_of(analysis: Analysis, config: BoundaryConfig) -> DataFrame:
    looked = candidates_of(analysis, config)
    ids = lambda *which: F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome").isin(*which), F.struct("side", "idx", "frame_id")))), lambda x: x["frame_id"])
    rejected = ("rejected", "contaminated") if config.reject_contaminated else ("rejected",)
    found = looked.groupBy("job_id", "bnd").agg(
        ids("recovered").alias("recovered"),
        ids(*rejected).alias("rejected"),
        ids("contaminated").alias("contaminated"),
        F.min_by("ts_ms", F.when(F.col("outcome") == "recovered", F.struct("side", "idx"))).alias("first_ms"),
    )
    # A representative counts on a boundary as long as the guard has not moved it.
    stayed = analysis.frames.where("chosen and is_rep")
    side = lambda name: stayed.select("job_id", F.col("frame_id").alias(f"{name}_rep"), *[F.col(c).alias(f"{name}_{c}") for c in ("ts_ms", "path", "label", "screen_type")])
    bounds = analysis.bounds.join(side("before"), ["job_id", "before_rep"], "left").join(side("after"), ["job_id", "after_rep"], "left")
    close = (F.abs(F.col("after_ts_ms") - F.col("before_ts_ms")) <= config.drift_ms) & (F.col("before_label") == F.col("after_label"))
    drift = F.coalesce((F.col("before_path") == F.col("after_path")) | close & (F.coalesce("before_screen_type", F.lit("")) == F.coalesce("after_screen_type", F.lit(""))), F.lit(False))
    nothing = F.array().cast(f"array<{analysis.frames.schema['frame_id'].dataType.simpleString()}>")
    joined = bounds.withColumn("drift", drift).join(found, ["job_id", "bnd"], "left").withColumns({c: F.coalesce(c, nothing) for c in ("recovered", "rejected", "contaminated")})
    any_back, lost = F.size("recovered") > 0, (F.size("contaminated") > 0) & (F.size("recovered") == 0)
    issue = F.when(lost, ONLY_CONTAMINATED).when(any_back & (F.col("first_ms") <= F.col("start_ms")), SKIPPED_BEFORE).when(any_back, SKIPPED_AFTER).when(F.col("drift"), REPEATED)
    warned = F.array_compact(F.array(F.when(F.col("drift"), WARN_DRIFT), F.when(lost, WARN_CONTAMINATED)))
    keep = ["job_id", "bnd", "boundary_id", "boundary_type", "start_ms", "end_ms", "peak_ms", "start_index", "end_index", "before_seg", "after_seg", "before_rep", "after_rep", "recovered", "rejected", "contaminated"]
    return joined.select(*keep, issue.isNotNull().alias("issue_detected"), issue.alias("issue_type"), warned.alias("warnings"))


def short_extra(found: Analysis, config: BoundaryConfig) -> DataFrame:
    """Representatives of short segments between others that were not selected and are not contaminated."""
    last = F.max("seg").over(Window.partitionBy("job_id"))
    reps = found.frames.where("is_rep").withColumn("__last", last)
    extra = reps.where((F.col("segment_type") == "short_stable") & (F.col("seg") > 1) & (F.col("seg") < F.col("__last")) & ~F.col("picked") & ~F.col("contaminated"))
    return extra.drop("__last").where(F.lit(config.preserve_short))


def summary(frames: DataFrame, segments: SegmentConfig, config: BoundaryConfig, zones: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """One row a job: boundaries, issues, recovered and rejected candidates, contaminated frames, doubtful representatives, short states brought back, warnings."""
    return summary_of(analyse(frames, segments, config, zones, selected), config)


def summary_of(found: Analysis, config: BoundaryConfig, listed: DataFrame | None = None) -> DataFrame:
    each = (report_of(found, config) if listed is None else listed).groupBy("job_id").agg(
        F.count("*").alias("boundaries_detected"),
        F.count_if("issue_detected").alias("issues_detected"),
        F.sum(F.size("recovered")).alias("recovered_states"),
        F.sum(F.size("rejected")).alias("candidates_rejected"),
        # In order of the boundaries that first have them.
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("bnd", "warnings"))), lambda x: x["warnings"]))).alias("warnings"),
    )
    of_frames = found.frames.groupBy("job_id").agg(F.count_if("contaminated").alias("contaminated_frames"), F.count("review").alias("edge_warnings"))
    short = short_extra(found, config).groupBy("job_id").agg(F.count("*").alias("short_state_preserved"))
    joined = of_frames.join(each, "job_id", "left").join(short, "job_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("boundaries_detected", "issues_detected", "recovered_states", "candidates_rejected", "edge_warnings", "short_state_preserved")}
    return joined.withColumns(counts | {"warnings": F.coalesce("warnings", F.array().cast("array<string>"))})


def brought_back(found: Analysis, config: BoundaryConfig) -> DataFrame:
    """Frames that are brought back by boundaries, once each: times, and the last boundary that does."""
    looked = candidates_of(found, config).where("outcome = 'recovered'")
    return looked.groupBy("job_id", "frame_id", "idx", "ts_ms").agg(F.count("*").alias("times"), F.max("bnd").alias("boundary"))


def final(frames: DataFrame, segments: SegmentConfig, config: BoundaryConfig, zones: DataFrame | None = None, selected: DataFrame | None = None) -> DataFrame:
    """Representatives, recovered frames and short states, once each, in time order; times counts how often one was recovered."""
    return final_of(analyse(frames, segments, config, zones, selected), config)


def final_of(found: Analysis, config: BoundaryConfig, again: DataFrame | None = None) -> DataFrame:
    """final() of analysed frames; again: brought_back() of them, if it is at hand."""
    who = ["job_id", "frame_id", "idx", "ts_ms"]
    none = {"times": F.lit(0).cast("long"), "boundary": F.lit(None).cast("int")}
    kept = found.frames.where("chosen").withColumns(none).select(*who, "times", "boundary", "review", F.lit(0).alias("stage"))
    back = (brought_back(found, config) if again is None else again).withColumn("review", F.lit(RECOVERED_REVIEW if config.mark_recovered else None).cast("string")).select(*who, "times", "boundary", "review", F.lit(1).alias("stage"))
    short = short_extra(found, config).withColumns(none).select(*who, "times", "boundary", F.lit(SHORT_REVIEW).alias("review"), F.lit(2).alias("stage"))
    # A short state that a boundary brings back too is there once; what is said last of it holds.
    job = Window.partitionBy("job_id", "frame_id")
    merged = kept.unionByName(back).unionByName(short).repartition("job_id").withColumns({"__n": F.row_number().over(job.orderBy(F.desc("stage"))), "times": F.max("times").over(job), "boundary": F.max("boundary").over(job)}).where("__n = 1")
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(F.coalesce("ts_ms", F.lit(10**12)), "idx"))
    return merged.drop("__n", "stage").withColumn("place", place)


#: Reasons to keep and to remove a frame.
KEPT_STABLE, KEPT_SINGLE, KEPT_RECOVERED, KEPT_SHORT = "stable_segment_representative", "single_frame_segment", "recovered_boundary_state", "short_state_preserved"
REMOVED_REST, REMOVED_MOVED, REMOVED_CONTAMINATED, REMOVED_DUPLICATE = "non_representative_segment_frame", "representative_replaced_near_transition_boundary", "transition_contaminated", "duplicate_removed_by_classifier"


def changes(found: Analysis, config: BoundaryConfig, again: DataFrame | None = None) -> DataFrame:
    """What segments, the edge guard, recovery and short states each say of frames (see timeline.apply_changes): stage 1 to 4; again: brought_back() of them, if it is at hand."""
    frames = found.frames
    says = lambda **values: [F.struct(v.alias("value")).alias(c) for c, v in values.items()]
    text = lambda v: F.lit(v).cast("string")
    fate = lambda final, keep, remove: says(status=text("final" if final else "removed"), is_final=F.lit(final), keep_reason=keep, remove_reason=remove)
    who = ["job_id", "frame_id"]
    review = lambda reason: says(needs_review=F.lit(True), review_reason=reason)
    segment = ordinal_id("segment", F.col("seg"))
    of_segment = says(segment_id=segment, segment_type=F.col("segment_type"))
    single = F.when(F.col("n_frames") == 1, KEPT_SINGLE).otherwise(KEPT_STABLE)
    score = says(transition_contamination_score=F.col("points") / 100, is_transition_contaminated=F.col("contaminated"), contamination_reason=F.col("reason"))
    stage = lambda n: F.lit(n).alias("stage")
    reps = frames.where("is_rep").select(*who, stage(1), *fate(True, single, text(None)), *of_segment, *score, *says(representative_for_segment=segment))
    others = frames.where("not is_rep").select(*who, stage(1), *fate(False, text(None), text(REMOVED_REST)), *of_segment, *score)
    moved = F.max("moved").over(Window.partitionBy("job_id", "seg"))
    rep = F.max(F.when(F.col("picked"), F.col("frame_id").cast("string"))).over(Window.partitionBy("job_id", "seg"))
    guard = frames.withColumns({"__moved": moved, "__rep": rep})
    # The one that takes over keeps the reason that it was removed for.
    taken = guard.where("moved").select(*who, stage(2), *says(status=text("final"), is_final=F.lit(True), keep_reason=text(KEPT_STABLE), representative_for_segment=segment, replaced_representative_id=F.col("__rep")))
    left = guard.where("picked and __moved").select(*who, stage(2), *fate(False, text(None), text(REMOVED_MOVED)))
    stayed = frames.where("review is not null").select(*who, stage(2), *review(F.col("review")))
    back = (brought_back(found, config) if again is None else again).select(*who, stage(3), *fate(True, text(KEPT_RECOVERED), text(None)), *says(boundary_recovery=F.lit(True), boundary_id=ordinal_id("boundary", F.col("boundary"))), *(review(text(RECOVERED_REVIEW)) if config.mark_recovered else []))
    short = short_extra(found, config).select(*who, stage(4), *fate(True, text(KEPT_SHORT), text(None)), *review(text(SHORT_REVIEW)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [reps, others, taken, left, stayed, back, short])


def drifting(chosen: DataFrame, within_ms: int) -> DataFrame:
    """Neighbouring chosen frames (job_id, seg, ts_ms, label) that say the same within a short time."""
    by = Window.partitionBy("job_id").orderBy("seg")
    pairs = chosen.withColumns({"next_seg": F.lead("seg").over(by), "next_ms": F.lead("ts_ms").over(by), "next_label": F.lead("label").over(by)})
    return pairs.where((F.col("next_label") == F.col("label")) & (F.col("next_ms") - F.col("ts_ms") <= within_ms)).select("job_id", "seg", "next_seg", "label")


def short_states(rolled: DataFrame) -> DataFrame:
    """Short segments between others."""
    last = F.max("seg").over(Window.partitionBy("job_id"))
    return rolled.withColumn("__last", last).where((F.col("segment_type") == "short_stable") & (F.col("seg") > 1) & (F.col("seg") < F.col("__last"))).drop("__last")
