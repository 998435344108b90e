"""Jobs that are too long for one task, against the rules row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup

MASK = 2**64 - 1


def away(a, b):
    return ((a ^ b) & MASK).bit_count()


def plain_consecutive(rows, threshold):
    last, kept = None, []
    for idx, sig, zone in sorted(rows):
        if zone or last is None or away(sig, last) >= threshold:
            kept.append(idx)
            last = None if zone else sig
    return kept


def plain_leaders(rows, threshold):
    kept = []
    for idx, sig, _ in sorted(rows):
        if all(away(sig, s) >= threshold for _, s in kept):
            kept.append((idx, sig))
    return [i for i, _ in kept]


def drifting(rng, n, step):
    """Signatures that change by a few bits from one to the next, stand still for a while, and jump."""
    sig, out = int(rng.integers(-(2**63), 2**63)), []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.02:
            sig = int(rng.integers(-(2**63), 2**63))
        elif kind < 0.6:
            for bit in rng.integers(0, 63, rng.integers(0, step)):
                sig ^= 1 << int(bit)
        out.append(sig)
    return out


@pytest.fixture(scope="module")
def jobs():
    rng = np.random.default_rng(21)
    found = {1: drifting(rng, 400, 3), 2: drifting(rng, 30, 4), 3: [5] * 150, 4: drifting(rng, 90, 2), 5: [int(x) for x in rng.integers(-(2**63), 2**63, 150)]}
    rows = []
    for job, sigs in found.items():
        # Gaps in idx, and zones.
        at = np.cumsum(rng.integers(1, 4, len(sigs)))
        zone = rng.random(len(sigs)) < (0.15 if job != 3 else 0.02)
        rows += [(job, int(i), s, bool(z)) for i, s, z in zip(at, sigs, zone, strict=True)]
    return rows


def by_job(rows):
    out = {}
    for job, *row in rows:
        out.setdefault(job, []).append(tuple(row))
    return out


def kept(frame):
    return sorted((r.job_id, r.idx) for r in frame.collect())


@pytest.mark.parametrize("block", [64, 10_000])
def test_last_kept(spark, jobs, block):
    frame = spark.createDataFrame(jobs, "job_id long, idx long, sig long, in_zone boolean").repartition(5)
    expected = sorted((j, i) for j, rows in by_job(jobs).items() for i in plain_consecutive(rows, 4))
    assert kept(dedup.consecutive_with_zones(frame, 4, block)) == expected
    without = sorted((j, i) for j, rows in by_job(jobs).items() for i in plain_consecutive([(i, s, False) for i, s, _ in rows], 6))
    assert kept(dedup.consecutive(frame.drop("in_zone"), 6, block)) == without


@pytest.mark.parametrize("block", [96, 10_000])
def test_leaders(spark, jobs, block):
    frame = spark.createDataFrame(jobs, "job_id long, idx long, sig long, in_zone boolean").repartition(5)
    expected = sorted((j, i) for j, rows in by_job(jobs).items() for i in plain_leaders(rows, 5))
    assert kept(dedup.leaders(frame, 5, block)) == expected


@pytest.mark.parametrize(("threshold", "chunk"), [(3, 4096), (8, 4096), (9, 40), (16, 4096), (16, 33), (30, 64)])
def test_near_pairs(spark, jobs, threshold, chunk):
    frame = spark.createDataFrame(jobs, "job_id long, idx long, sig long, in_zone boolean").repartition(5)
    expected = sorted((j, a, b, away(s, t)) for j, rows in by_job(jobs).items() for a, s, _ in rows for b, t, _ in rows if a < b and away(s, t) < threshold)
    assert sorted(tuple(r) for r in dedup.near_pairs(frame, threshold, chunk).collect()) == expected


def test_one_long_job_over_several_tasks(spark):
    """No task walks through all rows of the long job."""
    rng = np.random.default_rng(22)
    rows = [(1, i, s, False) for i, s in enumerate(drifting(rng, 5000, 3))]
    frame = spark.createDataFrame(rows, "job_id long, idx long, sig long, in_zone boolean")
    assert kept(dedup.consecutive_with_zones(frame, 4, 1024)) == [(1, i) for i in plain_consecutive([r[1:] for r in rows], 4)]
    assert dedup.leaders(frame.where("idx < 0"), 3, 16).count() == 0
    assert dedup.consecutive(frame.where("idx < 0"), 3, 16).count() == 0


def test_keys_of_text_and_other_columns(spark):
    rows = [("a", i, i % 7, "x") for i in range(40)] + [("b", i, 0, "y") for i in range(40)]
    frame = spark.createDataFrame(rows, "job_id string, idx long, sig long, k string")
    for found in (dedup.consecutive(frame, 2, 16), dedup.leaders(frame, 2, 16)):
        assert {r.job_id for r in found.collect()} == {"a", "b"}
    assert dedup.near_pairs(frame.withColumn("own", F.lit(1)), 9).select("job_id").distinct().count() == 2


@pytest.mark.parametrize("threshold", [0, 1, 3, 8, 9])
def test_leaders_meet_only_those_that_agree_in_a_block(threshold):
    """The index of blocks against all comparisons, also where very many signatures agree in all but one block."""
    rng = np.random.default_rng(23)
    crowd = [int(x) << 40 for x in rng.integers(-(2**23), 2**23, 300)]
    sigs = drifting(rng, 500, 4) + crowd + drifting(rng, 200, 3) + [s ^ 1 for s in crowd[:50]]
    held = dedup._Held(threshold)
    assert [i for i, s in enumerate(sigs) if held.taken(s)] == plain_leaders([(i, s, False) for i, s in enumerate(sigs)], threshold)


def test_jobs_are_walked_through_in_several_tasks(spark):
    frame = spark.createDataFrame([(j, i, i * 77, False) for j in range(12) for i in range(5)], "job_id long, idx long, sig long, in_zone boolean")
    for found in (dedup.leaders(frame, 3), dedup.consecutive_with_zones(frame, 3)):
        assert found.rdd.getNumPartitions() > 1
