"""Segments and last-kept frames of jobs whose frames arrive as a stream.

Frames have job_id, idx, ts (an event time) and, for kept(), sig. Segments close when the watermark has passed their
last frame by the gap, so a frame may arrive as late as the watermark allows, in any order. kept() looks back at
what it kept, so the frames of a job must arrive in order of idx from one trigger to the next; inside a trigger they are
put in order. Its state is one signature a job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.expressions import millis
from tidemark.operators.segments import SegmentConfig


def segments(frames: DataFrame, config: SegmentConfig, late: str = "0 seconds") -> DataFrame:
    """One row a segment that is over: job_id, start_index, end_index, start_ms, end_ms, n_frames and segment_type.

    Frames at most config.gap_ms apart are of one segment, as in operators.segments. Write it in append mode.
    """
    # A session window ends a gap after its last frame, that moment excluded.
    session = F.session_window("ts", f"{config.gap_ms + 1} milliseconds")
    at = millis(F.col("ts"))
    found = frames.withWatermark("ts", late).groupBy("job_id", session).agg(F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), F.min(at).alias("start_ms"), F.max(at).alias("end_ms"), F.count("*").alias("n_frames"))
    length = F.col("end_ms") - F.col("start_ms")
    kind = F.when(F.col("n_frames") == 1, "single_frame").when(length < config.short_ms, "short_stable").otherwise("stable")
    return found.drop("session_window").withColumn("segment_type", kind)


def kept(frames: DataFrame, threshold: int) -> DataFrame:
    """job_id and idx of the frames that are at least threshold bits from the last one kept of their job."""
    kind = frames.schema["job_id"].dataType.simpleString()

    def walk(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("idx")
        chosen = []
        for idx, sig in zip(rows["idx"].tolist(), rows["sig"].tolist(), strict=True):
            if last is None or ((last ^ sig) & (2**64 - 1)).bit_count() >= threshold:
                chosen.append(idx)
                last = sig
        state.update((last,))
        yield pd.DataFrame({"job_id": [key[0]] * len(chosen), "idx": chosen})

    narrow = frames.select("job_id", F.col("idx").cast("long").alias("idx"), "sig")
    return narrow.groupBy("job_id").applyInPandasWithState(walk, f"job_id {kind}, idx long", "last long", "append", GroupStateTimeout.NoTimeout)
