"""Frames, signatures and classified screens, from tables of the test schema or from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.expressions import millis, signature
from tidemark.operators.timeline import number_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, frame_id, ts_ms, idx, label and value: events as frames, users as jobs."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("frame_id"), millis(F.col("ts")).alias("ts_ms"), F.col("event_type").alias("label"), "value", "ts")
    return number_rows(events, "job_id", "ts", "frame_id").drop("ts")


def hashed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, frame_id, sig and idx: embeddings as frame signatures, labels as jobs."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("job_id"), F.col("vec_id").alias("frame_id"), signature(F.col("embedding")).alias("sig"))
    return number_rows(vectors, "job_id", "frame_id")


def screens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, idx, label, key_text, all_text, conf, components and state: documents as classified screens, languages as jobs."""
    docs = table(spark, sf_dir, "documents")
    words = F.split("text", " ")
    named = docs.select(
        F.col("lang").alias("job_id"),
        F.col("doc_id").alias("idx"),
        F.concat_ws("/", "lang", "source").alias("label"),
        F.split("text", "\n")[0].alias("key_text"),
        F.col("text").alias("all_text"),
        (F.pmod("doc_id", F.lit(100)) / 100.0).alias("conf"),
        F.slice(words, 1, 2).alias("components"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, "scrolled").otherwise("").alias("state"),
    )
    return named


def image_frames(spark: SparkSession, folder: str) -> DataFrame:
    """path, ordinal and pixels of the image files of a folder, in the order of their numbers."""
    found = spark.read.format("image").load(folder)
    ordinal = F.regexp_extract("image.origin", r"(\d+)\.\w+$", 1)
    return found.select(F.col("image.origin").alias("path"), ordinal.cast("long").alias("ordinal"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


ENTRY = "struct<idx:bigint,path:string,key_text:string,components:array<string>,state:string>"
#: Keys of the trees are data: maps, in the order of the document.
MANIFEST = f"manifest map<string,struct<images:array<{ENTRY}>,children:map<string,array<{ENTRY}>>>>, analysis map<string,string>"
SESSION = "funnel_sequence array<string>, paywall_position long, onboarding_count long, has_downsell boolean, strategy_coherence string, competitive_tier string, monetization_hypothesis string, onboarding_hypothesis string, feature_strategy_reasoning string"


def documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON documents as sinks.write_documents leaves them: job_id from the folder's name, and the columns of the schema."""
    return spark.read.schema(f"{schema}, job_id {_job_kind(spark, folder)}").json(folder)


def _job_kind(spark: SparkSession, folder: str) -> str:
    return spark.read.text(folder).schema["job_id"].dataType.simpleString()


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """job_id, manifest and analysis of written manifests: what manifest.sections and manifest.view take."""
    return documents(spark, folder, MANIFEST)


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Written session profiles: what manifest.session_list takes."""
    return documents(spark, folder, SESSION)
