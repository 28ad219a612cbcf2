"""Stored training-log tables: scans with required columns, and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from setledger import schemas as S
from setledger.functions.numbers import parse_number
from setledger.functions.times import ISO, iso_seconds, parse_timestamp
from setledger.operators.learning import with_model_group
from setledger.operators.sessions import coerce_sets, collapse_sessions, valid_sets
from setledger.sources.files import exists


def require(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Fail on absent columns; looks at the schema only."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column text: values are parsed by the operators.

    The header is read first, so the scan itself has a fixed schema."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    return spark.read.option("header", True).schema(S.all_strings(header)).csv(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_text_table(spark, path)


def read_raw_sets(spark: SparkSession, path: str) -> DataFrame:
    return require(_read(spark, path), S.RAW_SET_COLUMNS, "raw set log")


def _typed(df: DataFrame) -> DataFrame:
    """Text columns of a workout table to their types."""
    number = {"sets": "int", "reps": "int", "weight": "double", "rpe": "double", "rir": "double",
              S.TARGET: "double", "predicted_next_weight": "double", "row_id": "bigint", "user_id": "bigint"}
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    typed = {c: parse_number(F.col(c)).cast(t) for c, t in number.items() if c in text}
    if "date" in text:
        typed["date"] = F.when(F.col("date").rlike(r"^\d{4}-\d\d-\d\d$"), F.col("date").try_cast("date"))
    if "logged_at" in text:
        typed["logged_at"] = parse_timestamp(F.col("logged_at"), ISO)
    return df.withColumns(typed) if typed else df


def read_workouts(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """User log: base columns only, so a stored label never reaches user data. ``keep`` names key
    columns to carry along."""
    df = require(_read(spark, path), S.BASE_COLUMNS, "user workout table")
    return _typed(df.select(*keep, *S.BASE_COLUMNS))


def read_workouts_lenient(spark: SparkSession, path: str, keep: Sequence[str] = ()) -> DataFrame:
    """User log for display: nothing stored is an empty table, absent columns are missing."""
    fields = {f.name: f for f in S.WORKOUT_SCHEMA.fields}
    empty = spark.createDataFrame([], T.StructType([fields[c] for c in [*keep, *S.BASE_COLUMNS]]))
    if not exists(spark, path):
        return empty
    stored = _typed(_read(spark, path))
    present = [c for c in empty.columns if c in stored.columns]
    return empty.unionByName(stored.select(*present), allowMissingColumns=True)


def read_supervised(spark: SparkSession, path: str, grouped: bool = False) -> DataFrame:
    df = _typed(require(_read(spark, path), S.SUPERVISED_COLUMNS, "supervised table"))
    return with_model_group(df) if grouped else df


def read_for_rule_model(spark: SparkSession, path: str) -> DataFrame:
    df = require(_read(spark, path), S.RULE_MODEL_COLUMNS, "workout table")
    for column in ("rpe", "rir"):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(None).cast("double"))
    return _typed(df)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return _typed(require(_read(spark, path), S.EVALUATION_COLUMNS, "prediction table"))


def rebuild_if_missing(spark: SparkSession, user_path: str, raw_path: str) -> DataFrame:
    """The stored user table, or one derived from the raw sets when it is absent or empty."""
    if exists(spark, user_path):
        stored = read_workouts(spark, user_path)
        if not stored.isEmpty():
            return stored
    derived = collapse_sessions(valid_sets(coerce_sets(read_raw_sets(spark, raw_path))))
    write_table(derived.select(*S.BASE_COLUMNS), user_path)
    rebuilt = read_workouts(spark, user_path)
    if rebuilt.isEmpty():
        raise ValueError("the raw set log holds no usable rows")
    return rebuilt


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, or CSV with ISO dates when the path says so; lists become JSON text in CSV."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.rstrip("/").endswith(".parquet"):
        writer.parquet(path)
        return
    shown = {f.name: F.to_json(f.name) for f in df.schema.fields
             if isinstance(f.dataType, (T.ArrayType, T.StructType))}
    shown |= {f.name: iso_seconds(F.col(f.name)) for f in df.schema.fields
              if isinstance(f.dataType, T.TimestampNTZType)}
    flat = df.withColumns(shown) if shown else df
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_training_tables(split: DataFrame, folder: str, suffix: str = ".parquet") -> None:
    """Supervised table and its two parts, from one tagged frame."""
    write_table(split.drop("dataset"), f"{folder}/workouts{suffix}")
    for part in ("train", "test"):
        write_table(split.filter(F.col("dataset") == part).drop("dataset"), f"{folder}/{part}_workouts{suffix}")


def write_predictions(predictions: DataFrame, path: str) -> None:
    write_table(predictions, path)


def write_report(metrics: DataFrame, per_exercise: DataFrame, report: DataFrame, folder: str,
                 suffix: str = ".parquet") -> None:
    write_table(metrics, f"{folder}/metrics{suffix}")
    write_table(per_exercise, f"{folder}/per_exercise_metrics{suffix}")
    write_table(report, f"{folder}/model_report{suffix}")
