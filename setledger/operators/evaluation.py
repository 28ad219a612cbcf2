"""Prediction error: per row, overall, per exercise, per model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from setledger.schemas import TARGET

# Accuracy thresholds in pounds, inclusive.
THRESHOLDS = {"within_2_5_lb": 2.5, "within_5_lb": 5.0, "within_10_lb": 10.0}


def error_columns(df: DataFrame) -> DataFrame:
    error = F.col("predicted_next_weight") - F.col(TARGET)
    scored = df.withColumns({"error": error, "absolute_error": F.abs(error), "squared_error": error * error})
    return scored.withColumns({n: F.col("absolute_error") <= t for n, t in THRESHOLDS.items()})


def _share(flag: str):
    return F.avg(F.col(flag).cast("double"))


def overall_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row count, error means (3 places) and shares within each threshold (4 places)."""
    mse = F.avg("squared_error")
    return scored.groupBy(*by).agg(
        F.count("*").cast("double").alias("rows_evaluated"),
        F.bround(F.avg("absolute_error"), 3).alias("mae"),
        F.bround(F.sqrt(mse), 3).alias("rmse"),
        F.bround(mse, 3).alias("mse"),
        F.bround(F.avg("error"), 3).alias("mean_signed_error"),
        *[F.bround(_share(n), 4).alias(f"{n}_accuracy") for n in THRESHOLDS],
    )


def per_exercise_metrics(scored: DataFrame) -> DataFrame:
    """One row per exercise, most samples first, then smallest error before rounding."""
    grouped = scored.filter(F.col("exercise").isNotNull()).groupBy("exercise").agg(
        F.count("*").alias("samples"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg("error").alias("mean_signed_error"),
        _share("within_5_lb").alias("within_5_lb_accuracy"),
    )
    rounded = ["mae", "rmse", "mean_signed_error", "within_5_lb_accuracy"]
    ordered = grouped.orderBy(F.desc("samples"), F.asc("mae"), F.asc("exercise"))
    return ordered.select("exercise", "samples", *[F.bround(c, 3).alias(c) for c in rounded])


def top_exercises(scored: DataFrame, n: int = 10) -> DataFrame:
    """The report of the ``n`` exercises with the most samples."""
    return per_exercise_metrics(scored).limit(n)


def model_report(predictions: dict[str, DataFrame]) -> DataFrame:
    """Metrics of every model that has predictions, in one aggregate."""
    tagged = None
    for model, df in predictions.items():
        part = df.select("exercise", TARGET, "predicted_next_weight", F.lit(model).alias("model"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return overall_metrics(error_columns(tagged), by=["model"])


def prediction_range(df: DataFrame) -> DataFrame:
    both = [TARGET, "predicted_next_weight"]
    return df.agg(F.least(*[F.min(c) for c in both]).alias("min_weight"),
                  F.greatest(*[F.max(c) for c in both]).alias("max_weight"))


def error_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins from the smallest to the largest error; the last one is closed.

    A single distinct error is centred in a range of width one, as plotting tools do.
    """
    known = scored.filter(F.col("error").isNotNull())
    spread = known.agg(F.min("error").alias("lo"), F.max("error").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    edges = spread.select(F.struct(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                                   F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
                          .alias("edges"))
    placed = known.select("error", edges.scalar().alias("e"))
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    at = F.least(F.floor((F.col("error") - F.col("e.lo")) / (F.col("e.hi") - F.col("e.lo")) * bins),
                 F.lit(bins - 1)).cast("int")
    return (placed.select(at.alias("bin"), (F.col("e.lo") + at * width).alias("bin_start"))
            .groupBy("bin").agg(F.bround(F.min("bin_start"), 6).alias("bin_start"),
                                F.count("*").alias("n")))


def train_rows_per_group(labelled: DataFrame) -> DataFrame:
    """Usable training rows of each model group; ``global`` counts every row."""
    counts = labelled.filter(F.col(TARGET).isNotNull())
    by_group = F.explode(F.array_distinct(F.array(F.lit("global"), F.col("model_group"))))
    return (counts.groupBy("model_group").agg(F.count("*").alias("n"))
            .select(by_group.alias("model_group"), "n")
            .groupBy("model_group").agg(F.sum("n").alias("train_rows")))
