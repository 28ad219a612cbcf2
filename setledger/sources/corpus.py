"""Text corpora and link lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from setledger.functions.text import drop_bad_bytes, strip
from setledger.operators.documents import usable_text
from setledger.sources.files import exists


def read_text_corpus(spark: SparkSession, folders: Sequence[str], root: str = "") -> DataFrame:
    """One row per ``*.txt`` file: folder position, path below ``root``, file name, usable text.

    Absent folders, and files that are empty or hold an error placeholder, are left out. ``folder`` and
    ``source_file`` give the corpus order."""
    parts = spark.createDataFrame([], "folder int, path string, source_name string, raw_text string")
    for position, folder in enumerate(folders):
        if not exists(spark, folder):
            continue
        part = (spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
                .select(F.lit(position).alias("folder"), F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_name").alias("source_name"), drop_bad_bytes(F.col("value")).alias("raw_text")))
        parts = parts.unionByName(part)
    below = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^{root.rstrip('/')}/" if root else "^$", "")
    return usable_text(parts.withColumn("source_file", below).drop("path"))


def read_links(spark: SparkSession, path: str, comments: str | None = "#") -> DataFrame:
    """Trimmed, non-blank lines; ``comments`` marks lines to leave out."""
    links = spark.read.text(path).select(strip(F.col("value")).alias("url")).filter(F.col("url") != "")
    return links.filter(~F.col("url").startswith(comments)) if comments else links
