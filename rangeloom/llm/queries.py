"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, langmodel, linededup, neardup, packing, quality, segments, sharding, sql, warc
from .common import read


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(read(spark, sf_dir, "pages"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.sample_segmentations(read(spark, sf_dir, "documents"), k=3)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_verdicts(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score_corpus(read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.NearDuplicates(k=4, percent=80).find(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


#: A conversation whose texts are made of control strings.
PROBE = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_warc, op2_sentencepiece, op3_quality_rules, op4_decontamination, op5_line_dedup, op6_lm_scoring, op7_near_dedup, op8_sharding, op9_chat, op10_packing)}


def oracle_sql():
    return sql.ORACLES
