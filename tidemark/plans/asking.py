"""Asking models about images: one call a frame to classify it, one a job to analyse it.

A client is any object with ask(model, images, prompt) -> str that may raise; models are tried in order. Calls may
cost, so what was answered is stored before anything looks at it; frames that no model answered for
get the class that their pixels alone give. The prompt and the client are the caller's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pixels
from tidemark.functions.store import stored
from tidemark.operators import classify, manifest

#: Parts of an analysis, lengths that texts are cut to in records, images of an analysis, reasons.
ANALYSIS = ("domain_analysis", "monetization_hypothesis", "onboarding_hypothesis", "feature_strategy_reasoning", "copy_and_cta", "product_bets", "strategy_coherence", "competitive_tier")
ERROR_CHARS, RAW_CHARS, IMAGES = 400, 4000, 20
NOT_PARSED, NOT_LOADED = "JSON parse failed", "could not load image"


class Client(Protocol):
    def ask(self, model: str, images: list[bytes], prompt: str) -> str: ...


def in_order(client: Client, models: list[str], images: list[bytes], prompt: str, fits: Callable[[str], bool]) -> tuple[str | None, str | None, list[dict]]:
    """The first fitting answer and its model, and what went wrong before."""
    wrong = []
    for model in models:
        try:
            answer = (client.ask(model, images, prompt) or "").strip()
            if fits(answer):
                return answer, model, wrong
        except Exception as error:  # noqa: BLE001  a client is foreign code
            wrong.append({"model": model, "error": str(error)[:ERROR_CHARS]})
    return None, None, wrong


_ASKED = [("raw", pa.string()), ("model_used", pa.string()), ("attempts", pa.list_(pa.struct([("model", pa.string()), ("error", pa.string())])))]
ASKED = "raw string, model_used string, attempts array<struct<model:string,error:string>>"


def ask_each(frames: DataFrame, client: Client, models: list[str], prompt: str, tasks: int | None = None) -> DataFrame:
    """frames (with data, an image) with raw, model_used and attempts, stored; tasks bounds how many call at a time. Frames without data are not asked about."""
    kept = [f for f in frames.schema.fields if f.name != "data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", loaded boolean, {ASKED}"

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = batch.column("data").to_pylist()
            found = [in_order(client, models, [image], prompt, lambda answer: True) if image is not None else (None, None, []) for image in images]
            columns = [pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(_ASKED)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array([i is not None for i in images]), *columns], [*[f.name for f in kept], "loaded", *[n for n, _ in _ASKED]])

    return stored((frames.repartition(tasks) if tasks else frames).mapInArrow(called, schema))


def classified(asked: DataFrame) -> DataFrame:
    """ask_each() rows as screens with all columns of classify.normalise(), warnings, parsed and fallback_used; frame_index counts from 1 by idx.

    Frames with pixel features that no model answered for get the class of their pixels.
    """
    local = {"mean", "std", "bottom_mean"} <= set(asked.columns)
    failed = F.col("loaded") & F.col("model_used").isNull()
    rows = classify.answers(asked.withColumn("position", F.col("idx").cast("long")))
    if local:
        names = ["label", "screen_type", "conf", "components", "state"]
        clash = {c: f"__own_{c}" for c in names if c in rows.columns}
        rows = pixels.local_class(rows.withColumnsRenamed(clash))
        by_pixels = F.to_variant_object(F.struct(*names))
        rows = rows.withColumn("item", F.when(failed, by_pixels).otherwise(F.get("items", F.lit(0)))).drop(*names).withColumnsRenamed({v: k for k, v in clash.items()})
    else:
        rows = rows.withColumn("item", F.get("items", F.lit(0)))
    parsed = F.col("model_used").isNotNull() & classify.parse(F.col("raw")).isNotNull()
    flagged = rows.withColumns({"parsed": F.coalesce(parsed, F.lit(False)), "fallback_used": failed | ~F.col("loaded")}).drop("items")
    why = F.when(~F.col("loaded"), NOT_LOADED).when(F.col("model_used").isNotNull() & ~F.col("parsed"), NOT_PARSED)
    told = classify.normalise(flagged).withColumns({"frame_index": F.col("position") + 1, "uncertainty_reason": F.coalesce(why, "uncertainty_reason")}).drop("position")
    checked = classify.rules(told.withColumn("all_text", F.col("all_visible_text")) if "all_text" not in told.columns else told)
    return checked.withColumns({"needs_review": F.col("needs_review") | (F.size("warnings") > 0), "review_reason": classify.reasons(F.col("review_reason"), F.col("warnings"))})


def debug_documents(screens: DataFrame) -> DataFrame:
    """One row a job of classified(): counters, a record a frame, warnings by frame, and all that went wrong."""
    name = F.regexp_extract("path", r"([^/]*)$", 1) if "path" in screens.columns else F.lit(None).cast("string")
    item = F.struct(*[c for c in ("label", "screen_type", "conf", "key_text", "components", "state", "needs_review", "review_reason", "uncertainty_reason") if c in screens.columns])
    record = F.struct("frame_index", name.alias("frame_path_basename"), "model_used", F.substring("raw", 1, RAW_CHARS).alias("raw_response_snippet"), F.col("parsed").alias("parsed_ok"), item.alias("normalized_item"), "fallback_used")
    errors = F.transform("attempts", lambda a: F.struct(F.col("frame_index").alias("frame_index"), a["model"].alias("model"), a["error"].alias("error")))
    warned = F.when(F.size("warnings") > 0, F.struct("frame_index", "warnings"))
    in_order = lambda x: F.array_sort(F.collect_list(x))
    return screens.groupBy("job_id").agg(
        F.count("*").alias("frame_count"),
        F.count_if("loaded").alias("request_count"),
        F.count_if("parsed").alias("parsed_ok"),
        F.count_if(F.col("loaded") & F.col("fallback_used")).alias("fallback_used_count"),
        F.count_if("needs_review").alias("needs_review_count"),
        F.transform(in_order(F.when(F.col("model_used").isNotNull(), F.struct("frame_index", "model_used"))), lambda x: x["model_used"]).alias("models_used"),
        in_order(record).alias("frames"),
        F.map_from_entries(in_order(warned)).alias("validation_warnings_by_frame"),
        F.flatten(F.transform(in_order(F.struct("frame_index", errors.alias("e"))), lambda x: x["e"])).alias("errors"),
    )


def analyse(screens: DataFrame, client: Client, models: list[str], prompt: str) -> DataFrame:
    """job_id, model, attempts and analysis (eight texts, null if no model gave any), one call a job, stored.

    screens have job_id, idx, label and data; at most IMAGES of those that are worth it go into a call, evenly chosen. Jobs without any have no row.
    """
    worth = screens.where(~manifest.parent(F.col("label")).isin(*manifest.NO_ANALYSIS) & F.col("data").isNotNull())
    few = manifest.evenly(worth.select("job_id", "idx", "data"), IMAGES)
    kind = screens.schema["job_id"].dataType.simpleString()

    def fits(answer: str) -> bool:
        found = re.search(r"\{.*\}", answer, re.DOTALL)
        return found is not None and isinstance(json.loads(found.group()), dict)

    def called(key, group):
        images = group.sort_by("idx").column("data").to_pylist()
        found = in_order(client, models, images, prompt, fits)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], key[0].type), *[pa.array([v], t) for v, (_, t) in zip(found, _ASKED, strict=True)]], ["job_id", *[n for n, _ in _ASKED]])

    asked = stored(few.groupBy("job_id").applyInArrow(called, f"job_id {kind}, {ASKED}"))
    fields = ", ".join(f"{c} string" for c in ANALYSIS)
    return asked.select("job_id", F.col("model_used").alias("model"), "attempts", F.from_json(classify.first_object(F.col("raw")), fields).alias("analysis"))
