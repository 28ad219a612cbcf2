"""The training log as a table partitioned by year and month of the date.

A month is read without listing the files of the others. Appended batches leave small files behind; ``compact_log``
writes the partitions that hold too many of them anew, one table write for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from setledger.operators.activity import in_month
from setledger.session import pin

PERIOD = ("year", "month")
#: Files of a month from which it is written anew.
FILES = 8


def _by_month(logs: DataFrame) -> DataFrame:
    """Rows of a month together, in tasks of even size: large months are split, small ones share a task."""
    placed = logs.withColumns({"year": F.year("date"), "month": F.month("date")})
    return placed.hint("rebalance", *PERIOD)


def append_log(logs: DataFrame, folder: str) -> None:
    """Add rows; undated ones go to a partition of their own."""
    _by_month(logs).write.mode("append").partitionBy(*PERIOD).parquet(folder)


def read_log(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    if schema is None:
        return spark.read.parquet(folder)
    stored = [*schema.fields, *[T.StructField(name, T.IntegerType()) for name in PERIOD]]
    return spark.read.schema(T.StructType(stored)).parquet(folder)


def period(year: int, month: int | None = None) -> Column:
    at = F.col("year") == year
    return at if month is None else at & (F.col("month") == month)


def read_period(spark: SparkSession, folder: str, year: int, month: int | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """A year or a month of the log: the partitions of it, and within them the date range."""
    return in_month(read_log(spark, folder, schema).filter(period(year, month)), year, month).drop(*PERIOD)


def compact_log(spark: SparkSession, folder: str, files: int = FILES) -> int:
    """Write the months with more than ``files`` files anew; returns how many there were. Their rows are stored
    elsewhere first; partitions that are not named stay untouched."""
    logs = read_log(spark, folder)
    crowded = pin(logs.select(*PERIOD, F.col("_metadata.file_path").alias("file")).distinct()
                  .groupBy(*PERIOD).count().filter(F.col("count") > files).select(*[F.col(c).alias(f"_{c}") for c in PERIOD]))
    months = crowded.count()
    if months:
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PERIOD]
        rows = pin(logs.join(F.broadcast(crowded), same, "left_semi"))  # a row a month of the calendar
        (_by_month(rows.drop(*PERIOD)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*PERIOD).parquet(folder))
    return months
