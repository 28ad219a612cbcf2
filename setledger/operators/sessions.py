"""Set-level log to one row per session and exercise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from setledger.functions.numbers import at_least, coerce_number
from setledger.functions.text import coerce_text
from setledger.functions.times import parse_timestamp
from setledger.operators.ordering import ascending

SESSION = ("set_ts", "exercise")


def coerce_sets(raw: DataFrame, fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Typed set rows from the all-text raw log; other columns (a user key) pass through."""
    named = {"Date", "Exercise Name", "Set Order", "Weight", "Reps"}
    kept = [F.col(c) for c in raw.columns if c not in named]
    return raw.select(
        *kept,
        parse_timestamp(F.col("Date"), fmt).alias("set_ts"),
        coerce_text(F.col("Exercise Name")).alias("exercise"),
        coerce_number(F.col("Set Order")).cast("int").alias("set_order"),
        coerce_number(F.col("Weight")).alias("weight"),
        coerce_number(F.col("Reps")).alias("reps"),
    )


def valid_sets(sets: DataFrame) -> DataFrame:
    """Dated, named, and with a load or at least one repetition; names are trimmed already."""
    dated = F.col("set_ts").isNotNull()
    named = F.coalesce("exercise", F.lit("")) != ""
    return sets.filter(dated & named & ((F.col("weight") > 0) | (F.col("reps") > 0)))


def weight_classes(sets: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """Per session and weight: number of sets and the exact median of repetitions.

    The first aggregate turns rows into a histogram of (weight, reps) on the map side, so a
    session with very many rows reaches the median as a few counted values. All weights below
    zero form one class, marked -1: they matter only when a session has nothing else.
    """
    weight_class = F.when(F.col("weight") >= 0, F.col("weight")).otherwise(F.lit(-1.0))
    histogram = (sets.groupBy(*keys, weight_class.alias("weight_class"),
                              F.col("reps").cast("double").alias("reps"))
                 .agg(F.count("*").alias("n")))
    return histogram.groupBy(*keys, "weight_class").agg(
        F.sum("n").alias("class_sets"),
        F.percentile("reps", F.lit(0.5), F.col("n")).alias("median_reps"),
    )


def collapse_sessions(sets: DataFrame, keys: Sequence[str] = SESSION) -> DataFrame:
    """One row per session and exercise, at the session's working weight.

    Working weight: the most frequent positive weight, the heaviest on a tie; without a positive
    weight it is 0 and the unloaded sets count.
    """
    loaded = F.col("weight_class") > 0
    preference = F.struct(loaded.alias("loaded"),
                          F.when(loaded, F.col("class_sets")).otherwise(F.lit(0)).alias("votes"),
                          F.col("weight_class"))
    picked = weight_classes(sets, keys).groupBy(*keys).agg(
        F.max_by(F.struct("weight_class", "class_sets", "median_reps"), preference).alias("w"))
    extra = [k for k in keys if k not in SESSION]
    return picked.select(
        *extra,
        "exercise",
        at_least(F.col("w.class_sets"), 1).cast("int").alias("sets"),
        at_least(F.bround("w.median_reps").cast("int"), 0).alias("reps"),
        F.bround(at_least(F.col("w.weight_class"), 0.0), 2).alias("weight"),
        F.to_date("set_ts").alias("date"),
        F.lit(None).cast("double").alias("rpe"),
        F.lit(None).cast("double").alias("rir"),
        F.col("set_ts").alias("logged_at"),
    )


def sort_sets(sets: DataFrame) -> DataFrame:
    return sets.orderBy(*ascending(["set_ts", "exercise", "set_order"]))


def sort_sessions(workouts: DataFrame) -> DataFrame:
    return workouts.orderBy(*ascending(["date", "logged_at", "exercise"]))
