"""The corpus pipeline: five stages, each a table written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setledger.llm import decontaminate, line_duplicates, mixing, near_duplicates, toxicity
from setledger.llm.common import table
from setledger.session import pin

#: Words of a shingle in the near duplicate stage; the query op8 takes the four of its contract.
SHINGLE_WORDS = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. It is trained on the documents given."""
    model = toxicity.train_toxicity(docs, table(spark, folder, "labels"))
    return toxicity.toxicity_scores(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that occurred before, exactly or nearly, are taken out of the texts."""
    return line_duplicates.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies (five words a shingle, similarity 0.8) stays."""
    return near_duplicates.one_of_each(docs, width=SHINGLE_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.without_leaks(docs, table(spark, folder, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.taken_words(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks), ("mixing", mix)]

#: SQL can express neither the classifier nor the joins; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, folder))
    return docs
