"""Next-weight label and chronological split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from setledger.functions.vocabulary import TRAIN_RATIO
from setledger.operators.ordering import ascending, order_key, ranked, with_neighbours
from setledger.schemas import TARGET
from setledger.session import pin


def next_weight(workouts: DataFrame, keys: Sequence[str] = ("exercise",),
                tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Weight of the following session of the same key; rows without one are dropped."""
    named = workouts.filter(F.col(keys[-1]).isNotNull())
    labelled = with_neighbours(
        named, keys, ["date", "logged_at", *tie_breakers],
        lambda df, w: df.withColumn(TARGET, F.bround(F.lead("weight", 1).over(w), 2)), after=1)
    return drop_unlabelled(labelled)


def drop_unlabelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col(TARGET).isNotNull())


def sort_supervised(df: DataFrame) -> DataFrame:
    return df.orderBy(*ascending(["logged_at", "exercise"]))


def chronological_split(df: DataFrame, ratio: float = TRAIN_RATIO,
                        order: Sequence[str] = ("logged_at", "date", "exercise"),
                        name: str = "dataset") -> DataFrame:
    """Tag the first ``int(n * ratio)`` rows in time order ``train``, the others ``test``.

    No global sort: days are counted, the day that holds the last training row is found from
    the running count (one row per calendar day), and only that day is ranked. All rows are
    then compared with that one row, so tagging itself needs no shuffle; the row is stored, so that those who read the
    parts do not look for it again. ``order`` starts with the time and must end in a unique column for a repeatable split.
    """
    clock = order[0]
    day = F.to_date(clock)
    days = df.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    calendar = W.orderBy(F.col("day").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    size = F.floor(F.col("total") * F.lit(float(ratio))).cast("bigint")
    totals = days.agg(F.sum("n").alias("total"))
    running = (days.withColumn("upto", F.sum("n").over(calendar))
               .withColumn("total", totals.scalar())
               .withColumn("train_rows", size))
    reached = F.col("upto") >= F.col("train_rows")
    last_day = (running.filter(reached & (F.col("train_rows") > 0))
                .agg(F.min(F.struct(F.col("upto"), F.col("day"),
                                    (F.col("train_rows") - F.col("upto") + F.col("n")).alias("take")))
                     .alias("cut"))).first()["cut"]
    if last_day is None:
        return df.withColumn(name, F.lit("test"))
    on_day = df.filter(day.eqNullSafe(F.lit(last_day["day"]).cast("date")))
    last_row = pin(ranked(on_day, [], list(order), "place")
                   .filter(F.col("place") == last_day["take"])
                   .select(order_key(*order).alias("k")))
    return df.withColumn(name, F.when(order_key(*order) <= last_row.scalar(), "train").otherwise("test"))
