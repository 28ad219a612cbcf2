"""Fixed schemas of the stored tables; sources are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_SET_COLUMNS = ["Date", "Exercise Name", "Set Order", "Weight", "Reps"]
BASE_COLUMNS = ["exercise", "sets", "reps", "weight", "date", "rpe", "rir", "logged_at"]
TARGET = "actual_next_weight"
EFFORT_COLUMNS = ["sets", "reps", "weight", "rpe", "rir"]
RULE_MODEL_COLUMNS = ["exercise", "sets", "reps", "weight"]
SUPERVISED_COLUMNS = ["exercise", "sets", "reps", "weight", "rpe", "rir", "date", "logged_at", TARGET]
EVALUATION_COLUMNS = ["exercise", TARGET, "predicted_next_weight"]
DOCUMENT_FIELDS = ["title", "author", "website", "url", "type"]

WORKOUT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("exercise", T.StringType()),
    T.StructField("sets", T.IntegerType()),
    T.StructField("reps", T.IntegerType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("date", T.DateType()),
    T.StructField("rpe", T.DoubleType()),
    T.StructField("rir", T.DoubleType()),
    T.StructField("logged_at", T.TimestampNTZType()),
    T.StructField("row_id", T.LongType()),
])

PROFILE_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("goal", T.StringType()),
    T.StructField("experience_level", T.StringType()),
    T.StructField("equipment_access", T.ArrayType(T.StringType())),
    T.StructField("training_frequency", T.IntegerType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])


def all_strings(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
