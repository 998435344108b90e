"""Models in order, calls counted, local classes where none answers; and all rules of the pixel classifier."""

import json
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import pixels
from tidemark.functions.providers import classify
from tidemark.plans import asking


class Recorded:
    """A client that leaves a file for each call; the first model always fails."""

    def __init__(self, folder, answers):
        self.folder, self.answers = str(folder), answers

    def ask(self, model, images, prompt):
        (Path(self.folder) / uuid.uuid4().hex).write_text(json.dumps([model, len(images)]))
        if model == "first":
            raise RuntimeError("503 UNAVAILABLE " + "x" * 1000)
        return self.answers(images)


def calls(folder):
    return sorted(tuple(json.loads(p.read_text())) for p in Path(folder).iterdir())


def test_analysis_is_one_call_a_job(spark, tmp_path):
    def answer(images):
        return "Here: " + json.dumps({c: f"{c} of {len(images)}" for c in asking.ANALYSIS} | {"more": 1}) + " done" if len(images) > 1 else "no object"

    rows = [(1, i, "home" if i % 2 else "paywall/a", b"x") for i in range(50)] + [(2, 0, "home", b"x"), (3, 0, "transition", b"x"), (3, 1, "unsorted", b"x")]
    screens = spark.createDataFrame(rows, "job_id long, idx long, label string, data binary").repartition(3)
    found = asking.analyse(screens, Recorded(tmp_path, answer), ["first", "second", "third"], "why")
    for _ in range(2):
        got = {r.job_id: r for r in found.collect()}
    assert set(got) == {1, 2}
    assert got[1].model == "second" and got[1].analysis.competitive_tier == "competitive_tier of 20" and got[1].analysis.asDict().keys() == set(asking.ANALYSIS)
    assert len(got[1].attempts) == 1 and len(got[1].attempts[0].error) == 400
    assert got[2].model is None and got[2].analysis is None
    # Looked at twice, asked once.
    assert calls(tmp_path) == [("first", 1), ("first", 20), ("second", 1), ("second", 20), ("third", 1)]


def test_frames_are_asked_about_once(spark, tmp_path):
    def answer(images):
        return {b"good": '```json\n[{"label": "home/feed", "conf": 0.9, "key_text": "Hello", "all_visible_text": "Hello you"}]\n```', b"words": "nothing to say"}[images[0]]

    image = np.zeros((120, 80, 3), dtype=np.uint8)
    made = pixels.features(spark.createDataFrame([(i, 120, 80, 3, bytearray(image.tobytes())) for i in range(4)], "idx long, height int, width int, channels int, data binary"))
    data = F.when(F.col("idx") == 0, F.lit("good")).when(F.col("idx") == 1, F.lit("words")).when(F.col("idx") == 2, F.lit("unknown")).cast("binary")
    frames = made.withColumns({"job_id": F.lit(1), "path": F.format_string("in/f%d.jpg", "idx"), "data": data})
    asked = asking.ask_each(frames, Recorded(tmp_path, answer), ["first", "second"], "what", tasks=2)
    screens = asking.classified(asked)
    rows = {r.idx: r for r in screens.collect()}
    assert (rows[0].label, rows[0].model_used, rows[0].parsed, rows[0].fallback_used, rows[0].frame_index) == ("home/feed", "second", True, False, 1)
    assert (rows[1].label, rows[1].parsed, rows[1].uncertainty_reason) == ("unsorted", False, asking.NOT_PARSED)
    # No model knows the third: its pixels are black. The fourth has no image.
    assert (rows[2].label, rows[2].conf, rows[2].fallback_used, rows[2].model_used) == ("unsorted", 0.1, True, None)
    assert (rows[3].fallback_used, rows[3].uncertainty_reason) == (True, asking.NOT_LOADED)
    debug = asking.debug_documents(screens).first()
    assert (debug.frame_count, debug.request_count, debug.parsed_ok, debug.fallback_used_count, debug.models_used) == (4, 3, 1, 1, ["second", "second"])
    assert [f.frame_path_basename for f in debug.frames] == ["f0.jpg", "f1.jpg", "f2.jpg", "f3.jpg"] and debug.frames[1].raw_response_snippet == "nothing to say"
    assert [(e.frame_index, e.model) for e in debug.errors] == [(1, "first"), (2, "first"), (3, "first"), (3, "second")]
    assert debug.needs_review_count >= 2 and 3 in debug.validation_warnings_by_frame
    assert calls(tmp_path) == [("first", 1)] * 3 + [("second", 1)] * 3


RULES = [
    # mean, std, top, bottom, keys_row_std, keys_mean, tab_std, tab_rows, content_std -> label, conf, components, state
    ((10, 50, 90, 90, 50, 90, 50, 20, 50), ("unsorted", 0.1, [], "")),
    ((100, 20, 90, 90, 50, 90, 50, 20, 50), ("loading", 0.55, [], "")),
    ((150, 80, 50, 220, 50, 220, 50, 20, 50), ("bottom_sheet/sheet", 0.5, ["sheet_handle", "sheet_overlay"], "")),
    ((150, 80, 120, 180, 10, 180, 10, 20, 10), ("home", 0.25, [], "keyboard_open")),
    ((150, 80, 120, 180, 50, 180, 30, 20, 10), ("home", 0.4, ["bottom_tab_bar"], "")),
    ((150, 80, 120, 180, 50, 180, 30, 10, 50), ("onboarding", 0.3, [], "")),
    ((90, 80, 120, 80, 50, 80, 10, 20, 10), ("home", 0.25, ["dark_bg"], "")),
    ((150, 80, 120, 180, 50, 180, 10, 20, 10), ("home", 0.25, [], "")),
]


def test_rules_of_pixels(spark):
    names = "mean std top_mean bottom_mean keys_row_std keys_mean tab_std tab_rows content_std".split()
    rows = [(i, *map(float, values[:7]), values[7], float(values[8])) for i, (values, _) in enumerate(RULES)]
    frames = spark.createDataFrame(rows, "idx long, " + ", ".join(f"{n} {'int' if n == 'tab_rows' else 'double'}" for n in names))
    found = [(r.label, r.conf, r.components, r.state) for r in pixels.local_class(frames).orderBy("idx").collect()]
    assert found == [e for _, e in RULES]
    assert [(r.label, r.conf) for r in classify(frames, "pixels").orderBy("idx").collect()] == [e[:2] for _, e in RULES]
