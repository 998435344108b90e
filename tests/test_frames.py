"""Hand-derived cases of FIXTURES.md, pixel features, providers and the whole recording plan."""

import random
import re
import struct
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import pixels
from tidemark.functions.expressions import signature, strip
from tidemark.functions.providers import classify
from tidemark.operators import adaptive, boundaries, dedup, manifest, motion, segments, stability, timeline
from tidemark.operators import classify as answers
from tidemark.plans import recording
from tidemark.sources import image_tree, sinks, tables

SECOND = segments.SegmentConfig()


def timed(spark, times):
    return spark.createDataFrame([(1, f"f{i}", i, t) for i, t in enumerate(times)], "job_id long, frame_id string, idx long, ts_ms long")


def hashed(spark, values):
    return spark.createDataFrame([(1, i, i, v) for i, v in enumerate(values)], "job_id long, frame_id long, idx long, sig long")


def test_times_of_names(spark):
    names = spark.createDataFrame([("frame_0001.jpg",), ("frame_0004.jpg",), ("FRAME_0002.JPG",), ("frame_z0001_0001.jpg",)], "name string")
    assert [r[0] for r in names.select(timeline.time_of_name(F.col("name"), 4)).collect()] == [0, 750, 250, None]


def test_zones(spark):
    rows = [(1, i, m) for i, m in enumerate([0, 0, 20, 20, 0, 0])] + [(2, i, m) for i, m in enumerate([20, 0, 0, 0])] + [(3, 0, 0)]
    found = {r.job_id: r for r in motion.zones(spark.createDataFrame(rows, "job_id long, idx long, m long"), motion.MotionConfig()).collect()}
    one, two = found[1], found[2]
    assert (one.start_ms, one.end_ms, one.start_index, one.end_index, one.peak_ms, one.score, one.kind, one.dense_fps) == (166, 833, 1, 4, 333, 20, "multi", 15)
    assert (two.start_ms, two.end_ms, two.start_index, two.end_index, two.peak_ms, two.dense_fps) == (0, 333, 0, 1, 0, 30)
    assert 3 not in found


def test_segments(spark):
    frames = timed(spark, [0, 250, 500, 1100, 1350, 2500])
    rolled = segments.roll_up(frames, SECOND).orderBy("seg").collect()
    assert [(r.start_ms, r.end_ms, r.segment_type) for r in rolled] == [(0, 500, "stable"), (1100, 1350, "stable"), (2500, 2500, "single_frame")]
    assert [r.ts_ms for r in segments.representatives(frames, SECOND).orderBy("seg").collect()] == [250, 1100, 2500]
    assert [r.segment_type for r in segments.roll_up(timed(spark, [0, None, 500]), SECOND).collect()] == ["single_frame"] * 3
    assert [r.end_ms for r in segments.roll_up(timed(spark, [0, 500, 1001]), SECOND).orderBy("seg").collect()] == [500, 1001]


def test_recovery(spark):
    """FX-B1."""
    frames, bounds = timed(spark, [0, 250, 500, 1100, 1350, 2500]), recording.BoundaryConfig()
    final = recording.shown_frames(frames, SECOND, bounds).orderBy("place").collect()
    assert [r.ts_ms for r in final] == [0, 250, 1100, 1350, 2500]
    assert [r.ts_ms for r in final if r.times] == [0, 1350]
    found = boundaries.report(frames, SECOND, bounds).orderBy("bnd").collect()
    assert [(r.start_ms, r.end_ms, r.peak_ms) for r in found] == [(500, 1100, 800), (1350, 2500, 1925)]
    assert [(r.recovered, r.issue_type) for r in found] == [(["f0", "f4"], "skipped_pre_transition_state"), ([], None)]
    points = {r.ts_ms: r.points for r in boundaries.scored(frames, boundaries.detect(frames, SECOND), bounds).collect()}
    assert points == {0: 0, 250: 0, 500: 35, 1100: 35, 1350: 35, 2500: 35}
    reps = boundaries.guarded(frames, SECOND, bounds).orderBy("seg").collect()
    assert [(r.ts_ms, r.review) for r in reps] == [(250, None), (1100, boundaries.NEAR_REVIEW), (2500, boundaries.NEAR_REVIEW)]
    total = boundaries.summary(frames, SECOND, bounds).first()
    assert (total.boundaries_detected, total.issues_detected, total.recovered_states, total.candidates_rejected, total.edge_warnings, total.warnings) == (2, 1, 2, 0, 2, [])


def test_contamination(spark):
    """FX-C1: every combination of signs; exactly .65 counts."""
    rows, expected = [], []
    for i, (where, before, after, blurred) in enumerate(product((0, 1, 2, 3), (None, 0.5, 0.6), (None, 0.6), (None, 0.34, 0.35))):
        # Two boundaries, 1000-2000 and 2100-2200: far, near one, inside one, inside one and near the other.
        rows.append((i, f"f{i}", 0, (0, 900, 1500, 2000)[where], before, after, blurred))
        high = (before == 0.6, after == 0.6)
        expected.append(min(100, (0, 25, 35, 60)[where] + 20 * sum(high) + 15 * all(high) + 10 * (blurred == 0.34)))
    frames = spark.createDataFrame(rows, "job_id long, frame_id string, idx long, ts_ms long, motion_prev double, motion_next double, sharpness double")
    bounds = spark.createDataFrame([(i, s, e) for i in range(len(rows)) for s, e in ((1000, 2000), (2100, 2200))], "job_id long, start_ms long, end_ms long")
    found = boundaries.scored(frames, bounds, boundaries.BoundaryConfig()).orderBy("job_id").collect()
    assert [r.points for r in found] == expected
    assert [(r.contaminated, r.hard) for r in found] == [(x >= 65, x >= 82) for x in expected] and 65 not in {x for x in expected if x < 65}
    assert {r.reason for r in found if r.points == 0} == {"no_signal"}
    odd = spark.createDataFrame([(0, None, 1000), (0, 3000, None), (0, 6000, 5000)], "job_id long, start_ms long, end_ms long")
    at = spark.createDataFrame([(0, f"f{t}", t, t) for t in (900, 1100, 2900, 3100, 5100, 5500, 6100)] + [(0, "none", 9, None)], "job_id long, frame_id string, idx long, ts_ms long")
    assert {r.ts_ms: (r.inside, r.near) for r in boundaries.touched(at, odd, 180).collect()} == {None: (False, False), 5500: (False, False)} | dict.fromkeys((900, 1100, 2900, 3100, 5100, 6100), (False, True))


def test_rejected_candidates(spark):
    """Contaminated candidates are listed up to the second recovered one; motion zones come among the gaps."""
    times = [0, 100, 200, 300, 400, 1500]
    rows = [(1, f"f{i}", i, t, 0.9 if t in (100, 200) else 0.0, 0.9 if t in (100, 200) else 0.0) for i, t in enumerate(times)]
    frames = spark.createDataFrame(rows, "job_id long, frame_id string, idx long, ts_ms long, motion_prev double, motion_next double")
    zones = spark.createDataFrame([(1, None, 150, 210, 180)], "job_id long, kind string, start_ms long, end_ms long, peak_ms long")
    config = boundaries.BoundaryConfig(edge_ms=50, before_ms=500, after_ms=2000, most=1)
    found = boundaries.report(frames, SECOND, config, zones).orderBy("bnd").collect()
    assert [r.boundary_type for r in found] == ["transition", "segment_gap"] and [r.boundary_id for r in found] == ["boundary_0001", "boundary_0002"]
    # 100 is contaminated by 25 + 55 points; the zone is near 100, holds 200.
    assert (found[0].recovered, found[0].rejected) == (["f0"], [])
    # The frame at 0 has 55 points for motion and 10 for blur, the one at 200 lies near the zone too; 100 is the representative.
    rows = [(1, "f0", 0, 0, 0.9, 0.9, 0.1), (1, "f1", 1, 100, 0.0, 0.0, 0.9), (1, "f2", 2, 200, 0.9, 0.9, 0.9), (1, "f3", 3, 300, 0.0, 0.0, 0.9)]
    frames = spark.createDataFrame(rows, "job_id long, frame_id string, idx long, ts_ms long, motion_prev double, motion_next double, sharpness double")
    only = boundaries.report(frames, SECOND, config, spark.createDataFrame([(1, "multi", 250, 280, 265)], "job_id long, kind string, start_ms long, end_ms long, peak_ms long")).collect()
    assert [(r.recovered, r.contaminated, r.rejected, r.issue_type, r.warnings) for r in only] == [([], ["f0", "f2"], ["f0", "f2"], boundaries.ONLY_CONTAMINATED, [boundaries.WARN_CONTAMINATED])]


def test_meaning(spark):
    """FX-S1, FX-S2, and screens that differ in state alone."""
    rows = [(1, 0, "a", " Hi ", ["b", "a"], "x"), (1, 1, "a", "hi", ["a", "b"], "x"), (1, 2, "a", "hi", ["a", "b"], "y"), (1, 3, "b", "", [], ""), (1, 4, "b", None, [], ""), (1, 5, "b", "", ["p"], ""), (1, 6, "b", " ", ["p"], "")]
    found = dedup.first_of_meaning(spark.createDataFrame(rows, "job_id long, idx long, label string, key_text string, components array<string>, state string"))
    assert sorted(r.idx for r in found.collect()) == [0, 2, 3, 4, 5]


def test_profile(spark):
    """FX-P1."""
    steps = spark.createDataFrame([(1, i, x) for i, x in enumerate(["onboarding/a", "transition", "paywall/annual", "special_offer"])] + [(2, 0, "paywall/special_offer")], "job_id long, idx long, label string")
    one, two = manifest.funnel(steps).orderBy("job_id").collect()
    assert (one.sequence, one.paywall_position, one.onboarding_count, one.has_downsell) == (["onboarding/a", "paywall/annual", "special_offer"], 1, 1, True)
    assert two.has_downsell is False


def test_validation(spark):
    """FX-V1, FX-V2, and rules that look at the declared type."""
    rows = [("paywall", "", "hello", 0.9, False), ("home", "", "", 0.5, False), ("home", "Trial_Offer", "hello", 0.9, False), ("onboarding", "", "trial week plan", 0.9, False), ("home", "", "x" * 30, 0.9, True)]
    frames = spark.createDataFrame([(a, b, c, c, d, e) for a, b, c, d, e in rows], "label string, screen_type string, key_text string, all_text string, conf double, is_transition boolean")
    assert [r.warnings for r in answers.rules(frames).collect()] == [["paywall_without_pricing_text"], ["low_confidence"], ["paywall_without_pricing_text"], [], ["transition_with_content"]]


def test_stability(spark):
    """Slides and fades drop a frame only after a kept one; base rules and edges always."""
    far, kept = -1, 0
    config = stability.StabilityConfig()
    names = ["sig", "is_split", "left_hash", "right_hash", "edge_hash", "fade_error"]
    six = lambda i: (0b111111 << 6 * i) & (2**62 - 1)  # noqa: E731  signatures six bits and six bits apart
    rows = [(1, i, six(i), False, 0, 0, 0, 0.05) for i in range(9)]
    rows += [(2, 0, 0, False, 0, 0, 0, 1.0), (2, 1, 2**20 - 1, False, 0, 0, 0, 1.0), (2, 2, 0, False, 0, 0, 0, 1.0), (2, 3, 0, True, 0, 0, 0, 1.0)]
    rows += [(3, 0, 0, False, 0, 0, 0, 1.0), (3, 1, 1, False, 0, 0, 2**13 - 1, 1.0), (3, 2, 1, False, 0, 0, 0, 1.0)]
    found = stability.verdicts(spark.createDataFrame(rows, "job_id long, idx long, " + ", ".join(f"{n} {'boolean' if n == 'is_split' else 'double' if n == 'fade_error' else 'long'}" for n in names)), config)
    rules = {(r.job_id, r.idx): r.rule for r in found.collect()}
    assert [rules[1, i] for i in range(9)] == [None, "slide", None, "slide", None, "slide", None, "slide", None]
    assert [rules[2, i] for i in range(4)] == [None, "between_changes", None, "last_split"]
    assert [rules[3, i] for i in range(3)] == [None, "edge", None]
    assert far != kept


def test_dense_times(spark):
    zones = spark.createDataFrame([(1, "motion_0002", 100, 300, 30), (1, "motion_0003", 500, 500, 15), (1, "motion_0004", None, 5, 15)], "job_id long, zone_id string, start_ms long, end_ms long, dense_fps int")
    found = motion.dense_times(zones).orderBy("zone_id", "ordinal").collect()
    assert [r.ts_ms for r in found] == [100, 133, 166, 200, 233, 266, 500]
    assert found[0].name == "frame_z0002_0001.jpg" and found[-1].name == "frame_z0003_0001.jpg"


def test_sinks(spark, tmp_path):
    frames = timed(spark, [0, 250, 500, 1100, 1350, 2500]).withColumns({"status": F.when(F.col("idx") < 2, "final").otherwise("removed"), "source": F.lit("filename")})
    bounds = recording.BoundaryConfig()
    screens = spark.createDataFrame([(1, 0, "paywall/annual", "Buy", ["cta"], ""), (1, 1, "paywall/annual", "Buy now", [], "x"), (1, 2, "home", "Hi", None, None), (1, 3, "transition", "", [], "")], "job_id long, idx long, label string, key_text string, components array<string>, state string")
    analyses = spark.createDataFrame([(1, *"abcde")], "job_id long, " + ", ".join(f"{c} string" for c in sinks.ANALYSIS))
    profiles = manifest.funnel(screens.unionByName(screens.withColumn("job_id", F.lit(2).cast("long"))))
    written = {
        "timeline": sinks.timeline_documents(frames, 4),
        "segments": sinks.segment_documents(frames, SECOND),
        "boundaries": sinks.boundary_documents(frames, SECOND, bounds),
        "manifest": sinks.manifest_documents(manifest.tree(screens), analyses),
        "sessions": sinks.session_documents(profiles, analyses),
    }
    read = {}
    for name, documents in written.items():
        sinks.write_documents(documents, str(tmp_path / name))
        rows = spark.read.json(str(tmp_path / name)).collect()
        assert [r.job_id for r in rows] == [1]  # job 2 has no analysis, and so no session
        read[name] = rows[0]
    line = read["timeline"]
    assert (line.frame_count, line.final_count, line.summary.removed_count, line.summary.timestamp_strategy) == (6, 2, 4, "filename") and [x.ts_ms for x in line["items"]] == [0, 250, 500, 1100, 1350, 2500]
    assert [(s.segment_id, s.representative_timestamp_ms) for s in read["segments"].segments] == [("segment_0001", 250), ("segment_0002", 1100), ("segment_0003", 2500)]
    assert read["boundaries"].boundaries_detected == 2 and read["boundaries"].boundaries[0].recovered == ["f0", "f4"]
    node = read["manifest"].manifest.paywall.children.annual
    assert [(x.path, x.key_text, x.components, x.state) for x in node] == [("paywall__annual/000.jpg", "Buy", ["cta"], ""), ("paywall__annual/001.jpg", "Buy now", [], "x")]
    assert read["manifest"].manifest.home.images[0].path == "home/000.jpg" and read["manifest"].analysis.competitive_tier == "b"
    assert read["sessions"].funnel_sequence == ["paywall/annual", "paywall/annual", "home"] and read["sessions"].competitive_tier == "b"
    shown = {r.parent: r for r in manifest.sections(manifest.tree(screens), "http://h").collect()}
    assert [x.url for x in shown["paywall"].images] == ["http://h/images/1/paywall__annual/000.jpg", "http://h/images/1/paywall__annual/001.jpg"] and shown["home"].title == "Home"
    sinks.write_images(manifest.placed(screens).withColumn("data", F.lit("x").cast("binary")), str(tmp_path / "images"))
    found = {str(p.relative_to(tmp_path / "images")) for p in (tmp_path / "images").rglob("*") if p.is_file()}
    assert found == {"1/paywall__annual/000.jpg", "1/paywall__annual/001.jpg", "1/home/000.jpg"}


def test_writes_of_two_jobs_and_the_way_back(spark, tmp_path):
    """A second job, and a second write of the first, leave what is not theirs; what is read is what was written."""
    rows = [("zeta/b", "Z"), ("alpha", "A"), ("zeta/a", "Y"), ("zeta", "X"), ("transition", ""), ("alpha/c", "B"), ("zeta/b", "W")]
    shown = spark.createDataFrame([(j, i, label, text, [text], "s") for j in (1, 2) for i, (label, text) in enumerate(rows[j - 1 :])], "job_id long, idx long, label string, key_text string, components array<string>, state string")
    analyses = spark.createDataFrame([(1, *"abcde")], "job_id long, " + ", ".join(f"{c} string" for c in sinks.ANALYSIS))
    trees = sinks.manifest_documents(manifest.tree(shown), analyses)
    folder = str(tmp_path / "manifests")
    for job in (1, 2, 1):
        sinks.write_documents(trees.where(F.col("job_id") == job), folder)
    back = tables.manifests(spark, folder)
    assert sorted(r.job_id for r in back.collect()) == [1, 2]
    plain = lambda df: sorted((r.job_id, r.position, r.title, [(x.url, x.key_text, x.components, x.state) for x in r.images]) for r in df.collect())
    direct = plain(manifest.sections(trees, "http://h"))
    assert plain(manifest.sections(back, "http://h")) == direct
    # As they first appear; a parent's own images before its children's.
    assert [(t, [x[1] for x in images]) for job, _, t, images in direct if job == 1] == [("Zeta", ["X", "Z", "W", "Y"]), ("Alpha", ["A", "B"])]
    views = {r.job_id: r for r in manifest.view(back, "http://h").collect()}
    assert views[1].analysis["competitive_tier"] == "b" and views[2].analysis is None and [s.title for s in views[1].sections] == ["Zeta", "Alpha"]
    profiles = sinks.session_documents(manifest.funnel(shown), analyses.unionByName(analyses.withColumn("job_id", F.lit(2).cast("long"))))
    for job in (1, 2):
        sinks.write_documents(profiles.where(F.col("job_id") == job), str(tmp_path / "sessions"))
    listed = {r.job_id: r for r in manifest.session_list(tables.sessions(spark, str(tmp_path / "sessions"))).collect()}
    assert {j: (r.competitive_tier, r.funnel_length) for j, r in listed.items()} == {1: ("b", 6), 2: ("b", 5)}
    for job in (1, 2):
        images = manifest.placed(shown.where(F.col("job_id") == job)).withColumn("data", F.concat(F.lit("image "), "key_text").cast("binary"))
        sinks.write_images(images, str(tmp_path / "images"))
    assert (tmp_path / "images/1/zeta__b/001.jpg").read_text() == "image W" and (tmp_path / "images/2/alpha/000.jpg").read_text() == "image A"
    assert not [p for p in (tmp_path / "images").rglob(".*")]


def test_image_files_of_a_failed_write_go(spark, tmp_path):
    rows = spark.createDataFrame([(1, f"a/{i:03d}.jpg", b"x") for i in range(8)], "job_id long, path string, data binary").repartition(4)
    folder = str(tmp_path / "images")
    bad = rows.withColumn("data", F.when(F.col("path") == "a/005.jpg", F.raise_error(F.lit("no such image")).cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="no such image"):
        image_tree.write(bad, folder)
    image_tree.write(rows, folder)
    assert len(list((tmp_path / "images").rglob("*.jpg"))) == 8


def test_odd_labels_and_numbers(spark):
    raw = ['{"label": 0, "screen_type": "home"}', '{"label": false}', '{"label": "a/b", "frame_index": "2.7"}', '{"label": 7, "frame_index": 2.7}', '{"label": [], "screen_type": "", "frame_index": " 4 "}']
    items = spark.createDataFrame(list(enumerate(raw)), "position long, raw string").withColumn("item", F.parse_json("raw"))
    found = [(r.label, r.screen_type, r.frame_index) for r in answers.normalise(items).orderBy("position").collect()]
    assert found == [("home", "home", 1), ("unsorted", "unsorted", 2), ("a/b", "a", 3), ("7", "7", 2), ("unsorted", "unsorted", 4)]


def test_white_space_of_unicode(spark):
    texts = ["\u00a0a\u3000", "\x1cb\x1f", " c d\n", "\u2009", ""]
    shown = spark.createDataFrame([(t,) for t in texts], "t string").select(strip(F.col("t")))
    assert [r[0] for r in shown.collect()] == [t.strip() for t in texts]


def test_dedup(spark):
    assert sorted(r.idx for r in dedup.consecutive(hashed(spark, [0b0, 0b1, 0b11, 0b111]), 3).collect()) == [0, 3]
    assert sorted(r.idx for r in dedup.consecutive(hashed(spark, [0, 7, 0]), 3).collect()) == [0, 1, 2]
    assert sorted(r.idx for r in dedup.leaders(hashed(spark, [0, 7, 0]), 3).collect()) == [0, 1]


def test_json(spark):
    """FX-J1, and a fence with words in it, brackets that do not close, an array after an object."""
    raw = ['```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 2}} ok', 'x [1, {"a": 2}] y', "nothing", '[x {"a":1}', '```\nsee {"a": 3} there\n``` {"b": 1}', "", " } { ", '{"a": [1]} [2]']
    found = [r[0] for r in spark.createDataFrame([(r,) for r in raw], "raw string").select(answers.isolate(F.col("raw"))).collect()]
    assert found == ['{"a": 1}', '{"a": {"b": 2}}', '[1, {"a": 2}]', "nothing", '{"a":1}', '{"a": 3}', "", "} {", '{"a": [1]}']
    wide = [r[0] for r in spark.createDataFrame([("a {1} {2} b",), ("none",)], "raw string").select(answers.first_object(F.col("raw"))).collect()]
    assert wide == ["{1} {2}", None]


def test_odd_answers(spark):
    """Answers of every shape become as many rows as there are frames, typed whatever came."""
    raw = ['[1, {"label": 5, "conf": "0.5", "components": 7, "needs_review": 1, "frame_index": "4"}]', '{"label": "", "screen_type": "home", "conf": true, "components": null, "state": "scrolled", "is_transition": "yes"}', '{"items": [], "frames": 3}', "[[]]", None]
    table = spark.createDataFrame([(i, r, 2) for i, r in enumerate(raw)], "k long, raw string, expected int")
    found = {(r.k, r.position): r for r in answers.normalise(answers.exactly(answers.answers(table), "expected")).collect()}
    assert len(found) == 10
    one = found[0, 1]
    assert (one.label, one.conf, one.components, one.needs_review, one.frame_index) == ("5", 0.5, ["7"], True, 4)
    assert (found[0, 0].uncertainty_reason, found[0, 0].review_reason, found[0, 0].frame_index) == ("item at index 0 was not an object", "classification_fallback", 1)
    two = found[1, 0]
    assert (two.label, two.screen_type, two.conf, two.components, two.is_scroll_state, two.is_transition) == ("home", "home", 1.0, [], True, True)
    assert found[1, 1].uncertainty_reason == "missing item from Gemini response" and found[3, 0].needs_review and found[4, 1].label == "unsorted" and found[2, 0].label == "unsorted"


def test_pixels_and_providers(spark):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 256, (120, 80, 3), dtype=np.uint8), np.zeros((120, 80, 3), dtype=np.uint8)]
    images.append(images[0])
    frames = spark.createDataFrame([(i, 120, 80, 3, bytearray(x.tobytes())) for i, x in enumerate(images)], "idx int, height int, width int, channels int, data binary")
    found = pixels.features(frames)
    rows = found.orderBy("idx").collect()
    assert rows[0].full_hash == rows[2].full_hash != rows[1].full_hash
    assert rows[1].mean == 0 and 100 < rows[0].mean < 155 and len(rows[0].thumb) == 64 * 64
    a, b = np.array(rows[0].thumb), np.array(rows[1].thumb)
    fade = spark.createDataFrame([((a * 0.5 + b * 0.5).tolist(), a.tolist(), b.tolist())], "t array<double>, p array<double>, n array<double>")
    assert fade.select(pixels.fade_error(F.col("t"), F.col("p"), F.col("n"))).first()[0] < 1e-9
    assert [r.label for r in classify(found, "pixels").orderBy("idx").collect()] == ["home", "unsorted", "home"]
    assert [(r.label, r.conf) for r in pixels.local_class(found).orderBy("idx").collect()][1] == ("unsorted", 0.1)
    assert len(rows[0].splits) == 3 and rows[0].content_hash == pixels.perceptual_hash(pixels.gray(bytes(images[0].tobytes()), 120, 80, 3)[60:])
    assert {r.label for r in classify(found, "no such provider").collect()} == {"unsorted"}


def test_plan(spark):
    rng = np.random.default_rng(2)
    states = rng.integers(-(2**63), 2**63, 6)
    frames = hashed(spark, [int(s) for s in np.repeat(states, 5)])
    kept = recording.stable_frames(frames, motion.MotionConfig(), change=18, near=3, moving=15).orderBy("idx").collect()
    signatures = [r.sig for r in kept]
    assert len(signatures) == len(set(signatures)) and signatures[0] == states[0]


def png(image):
    """A gray image as a file."""
    height, width = image.shape
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + r.tobytes() for r in image)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_scan(spark, tmp_path):
    """Three screens, each held for some frames, with a fade between two of them and a blank frame."""
    rng = np.random.default_rng(6)
    screens = [np.kron(rng.integers(40, 216, (16, 10)), np.ones((12, 12))).astype(np.uint8) for _ in range(3)]
    fade = (screens[0] * 0.5 + screens[1] * 0.5).astype(np.uint8)
    shown = [screens[0]] * 3 + [fade] + [screens[1]] * 3 + [np.zeros_like(fade)] * 3 + [screens[2]] * 3 + [screens[0]] * 2
    for i, image in enumerate(shown, 1):
        (tmp_path / f"frame_{i:04d}.png").write_bytes(png(image))
    frames = recording.scan(spark, str(tmp_path), 4)
    rows = frames.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(len(shown))) and rows[0].frame_id == "frame_0001" and rows[0].ts_ms is None  # no .jpg
    config = stability.StabilityConfig(split=64, edge_next=-1)
    kept = recording.held_frames(frames, config, moving=15, near=3).orderBy("idx").collect()
    assert [r.idx for r in kept] == [0, 4, 10]


def test_leaders_keep_more_than_they_hold_at_first(spark):
    rng = np.random.default_rng(8)
    found = dedup.leaders(hashed(spark, [int(x) for x in rng.integers(-(2**63), 2**63, 200)] * 2), 3).collect()
    assert sorted(r.idx for r in found) == list(range(200))


def test_side_by_side(spark):
    a, b = timed(spark, [0, 1, 2]), spark.createDataFrame([(1, i, f"l{i}") for i in range(2)], "job_id long, idx long, label string")
    assert sorted(r.label for r in timeline.side_by_side(a, b).collect()) == ["l0", "l1"]
    paths = spark.createDataFrame([(1, "p"), (1, "q")], "job_id long, path string")
    assert timeline.all_paths(paths, paths.limit(1)).count() == 2


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString().lower()


def test_nearest_goes_through_a_job_once_each_way(spark):
    rng = random.Random(3)
    frames = [(1, i, rng.choice([None, *range(60)]), i * 7) for i in range(40)] + [(2, 5, 9, 1)]
    wanted = [(job, t, t) for job in (1, 2, 3) for t in (None, *range(-2, 64))]
    found = adaptive.nearest(spark.createDataFrame(wanted, "job_id long, ts_ms long, tag long"), spark.createDataFrame(frames, "job_id long, frame_id long, ts_ms long, sig long"))
    assert "unboundedfollowing" not in _plan(found)
    got = {(r.job_id, r.tag): r.frame and (r.frame.frame_id, r.frame.ts_ms, r.frame.sig) for r in found.collect()}

    def plain(job, t):
        own = [f for f in frames if f[0] == job and f[2] is not None]
        return min(((abs(f[2] - t), f[2], f[1]), f[1:]) for f in own)[1] if own and t is not None else None

    assert len(got) == len(wanted) and all(got[j, t] == plain(j, t) for j, t, _ in wanted)


def test_zones_meet_frames_without_pairs(spark):
    zones = [(1, 3, 5), (1, 4, 4), (1, 9, 20), (1, 10, 12), (2, 0, 0), (None, 0, 9)]
    frames = [(job, i, "x") for job in (1, 2, 3, None) for i in (None, *range(25))]
    given = spark.createDataFrame(frames, "job_id long, idx long, `a.b` string"), spark.createDataFrame(zones, "job_id long, start_index long, end_index long")
    inside = {(j, i) for j, i, _ in frames if j is not None and i is not None and any(z[0] == j and z[1] <= i <= z[2] for z in zones)}
    for which in (True, False):
        found = motion.in_zone(*given, inside=which)
        assert "join" not in _plan(found) and found.columns == ["job_id", "idx", "a.b"]
        assert sorted(found.collect(), key=repr) == sorted([f for f in frames if ((f[0], f[1]) in inside) == which], key=repr)


def test_signature_sorts_a_vector_once(spark):
    rng = random.Random(5)
    vectors = [[rng.choice([rng.gauss(0, 1), 0.0, 1.0]) for _ in range(64)] for _ in range(50)] + [[1.0] * 5, [None] * 40 + [2.0] * 24]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<float>").select("i", signature(F.col("v")).alias("s"))
    assert len(re.findall("sort", _plan(frame))) <= 2
    for row in frame.collect():
        v = [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in vectors[row.i]]
        low = sorted(x for x in v if x is not None)
        middle = (low[31] + low[32]) / 2 if len(low) > 32 else None
        bits = sum(1 << i for i, x in enumerate(v) if middle is not None and x is not None and x > middle)
        assert row.s & (2**64 - 1) == bits


def test_recovered_frames_at_hand_are_not_looked_for_again(spark):
    config = boundaries.BoundaryConfig()
    found = boundaries.analyse(timed(spark, [0, 100, 900, 1000, 1600, 1700, 2600, 2700]), SECOND, config)
    again = boundaries.brought_back(found, config).localCheckpoint()
    for made in (boundaries.final_of, boundaries.changes):
        plain, handed = made(found, config), made(found, config, again)
        assert _plan(plain).count("join") > _plan(handed).count("join")
        assert sorted(plain.collect(), key=repr) == sorted(handed.collect(), key=repr)


def test_adaptive_passes_compute_their_frames_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = random.Random(6)
    rows = [(job, i, i, f"frame_{i + 1:04d}.jpg", rng.getrandbits(62)) for job in (1, 2) for i in range(40)]
    kind = "job_id long, frame_id long, idx long, path string, sig long"
    frames = spark.createDataFrame(rows, kind).mapInArrow(counted, kind)
    source = spark.createDataFrame([(j, i, i * 33, s) for j, i, _, _, s in rows], "job_id long, frame_id long, ts_ms long, sig long")
    both, zones = adaptive.extract(frames, source, motion.MotionConfig(motion=37, anomaly=34), 33, 28)
    assert both.count() > 0 and zones.count() > 0 and seen.value == len(rows)
