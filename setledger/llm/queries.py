"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from setledger.llm import (chat, decontaminate, html_text, language, lexical_search, licenses, line_duplicates, mixing,
                           near_duplicates, quality, resample, simhash, toxicity)
from setledger.llm.common import held_out, table

#: The conversation that the contract adds (fixed values).
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE_TEXT).alias("text"))
    return chat.read_back(chat.format_turns(rows.select("conv_id", "turn", "role", "text").unionByName(probe)))


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train_toxicity(docs, table(spark, folder, "labels"))
    scored = toxicity.toxicity_scores(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    told = language.identify(docs.select("doc_id", "text"), language.training_samples(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_main_text(table(spark, folder, "pages"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op9_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return line_duplicates.line_report(table(spark, folder, "documents"))


def op11_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


def op12_target_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (op1_license_scan, op2_quality_rules, op3_chat_format, op4_mix_sources, op5_toxicity,
                            op6_language, op7_main_text, op8_near_duplicates, op9_benchmark_leaks, op10_repeated_lines,
                            op11_simhash_groups, op12_target_resample, op13_lexical_search)}

SQL: dict[str, str] = {"op4_mix_sources": mixing.taken_sql(), "op12_target_resample": resample.resample_sql(),
                       "op13_lexical_search": lexical_search.search_sql()}
