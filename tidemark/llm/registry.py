"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversations, decontaminate, kmeans, kneser_ney, langid, licenses, lpf, mixing, pii, quality_rules, sentencepiece, simhash, sql, winnow
from tidemark.llm.ship import ship
from tidemark.llm.text import documents


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.scan(docs, pii.fit(docs))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(kind) for kind in pii.BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), *[count(k) for k in pii.KINDS if k not in pii.BASE])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.digests(documents(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(documents(spark, sf_dir), sentencepiece.load())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir), words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit_documents(docs))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.scores(documents(spark, sf_dir))
    return found.withColumn("bits_per_byte", -F.col("score") * F.log(2.0, F.lit(10.0)) / (F.col("n_bytes") + 1)).drop("n_bytes")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compared(documents(spark, sf_dir))


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults: by the checksum of its number a turn is dropped, emptied, cut short, repeated (copies) or given to the user."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.report_all(_damaged(rows), rows, copies="copies")


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return kmeans.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii, op2_suffix_dedup, op3_sentencepiece, op4_quality_classifier, op5_simhash, op6_quality_rules, op7_decontamination, op8_language_id, op9_lm_scores, op10_license_scan, op11_winnowing, op12_conversation_repair, op13_hamerly)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return sql.all_sql()
