"""Streaming forms of log ingest, lift state, daily quota, online prediction and profiles.

Each micro-batch runs the batch operators inside ``foreachBatch`` and writes one folder named
by the batch id, so a repeated batch replaces its own output. The newest row of every key is kept as a
snapshot and a few deltas (``state``). The quota has two forms: ``quota_sink`` counts the day folders of earlier
batches, ``quota.start_quota`` keeps keyed state and reads nothing back. No single task holds all rows of a busy key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from setledger.functions.vocabulary import DAILY_PROMPTS
from setledger.operators.activity import accepted_entries, rejected_entries
from setledger.operators.rules import predict_by_rule
from setledger.sources.files import exists
from setledger.streaming.state import EVERY, FoldedState


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
          once: bool = True) -> StreamingQuery:
    """Run ``sink`` per micro-batch; ``once`` drains what is there and stops."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = start(stream, sink, checkpoint)
    query.awaitTermination()


def _write_batch(df: DataFrame, folder: str, batch: int, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{folder}/batch_id={batch}")


def _earlier(spark: SparkSession, folder: str, schema: T.StructType, batch: int) -> DataFrame:
    """Rows of earlier batches; a batch that is being repeated does not see its own output."""
    if not exists(spark, folder):
        return spark.createDataFrame([], schema)
    stored = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(stored).parquet(folder).filter(F.col("batch_id") < batch).drop("batch_id")


def ingest_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Valid entries are appended, invalid ones go to a side table with the reason."""
    def sink(entries: DataFrame, batch: int) -> None:
        entries.persist()
        _write_batch(accepted_entries(entries), f"{folder}/accepted", batch)
        _write_batch(rejected_entries(entries), f"{folder}/rejected", batch)
        entries.unpersist()
    return sink


def newest_rows(rows: DataFrame) -> DataFrame:
    """Newest row per user and exercise; combined on the map side."""
    columns = [c for c in rows.columns if c not in ("user_id", "exercise")]
    newest = F.struct(F.col("logged_at"), F.col("date"), -F.col("row_id"))
    return rows.groupBy("user_id", "exercise").agg(F.max_by(F.struct(*columns), newest).alias("r")).select(
        "user_id", "exercise", "r.*")


def lift_state_sink(folder: str, every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """Newest row per user and exercise: a snapshot and the changed rows of the batches since."""
    return FoldedState(folder, newest_rows, every).sink


def lift_state(spark: SparkSession, folder: str) -> DataFrame:
    return FoldedState(folder, newest_rows).current(spark)


def quota_sink(folder: str, limit: int = DAILY_PROMPTS) -> Callable[[DataFrame, int], None]:
    """Accept each user's first ``limit`` prompts of a day, counting those of earlier batches.

    Only the first ``limit`` rows of a user and day within a batch can be accepted, so the
    ranking keeps no more than those of a group in any task. The decision is joined back by the
    unique event id. Accepted rows are stored by day, so counting reads the folders of the
    batch's days only; the list of days is bounded by the calendar.
    """
    columns = ["event_id", "user_id", "ts", "day", "used"]

    def sink(prompts: DataFrame, batch: int) -> None:
        spark = prompts.sparkSession
        keyed = prompts.withColumn("day", F.to_date("ts")).persist()
        schema = T.StructType([keyed.schema[c] for c in columns[:-1]] + [T.StructField("used", T.LongType())])
        days = [r["day"] for r in keyed.select("day").distinct().collect()]
        before = (_earlier(spark, f"{folder}/accepted", schema, batch).filter(F.col("day").isin(days))
                  .groupBy("user_id", "day").agg(F.count("*").alias("_before")))
        first = W.partitionBy("user_id", "day").orderBy("ts", "event_id")
        candidates = keyed.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit)
        numbered = (candidates.join(before, ["user_id", "day"], "left")
                    .withColumn("used", F.col("_n") + F.coalesce("_before", F.lit(0).cast("bigint"))))
        _write_batch(numbered.filter(F.col("used") <= limit).select(*columns), f"{folder}/accepted", batch, by="day")
        accepted = spark.read.schema(schema).parquet(f"{folder}/accepted/batch_id={batch}").select("event_id")
        turned_away = keyed.join(accepted, "event_id", "left_anti").select(*columns[:-1])
        _write_batch(turned_away, f"{folder}/rejected", batch)
        keyed.unpersist()
    return sink


def online_predictions(rows: DataFrame) -> DataFrame:
    """The rule predictor keeps no state: the batch projection runs on the stream as it is."""
    return predict_by_rule(rows)


def prediction_sink(folder: str) -> Callable[[DataFrame, int], None]:
    def sink(rows: DataFrame, batch: int) -> None:
        _write_batch(online_predictions(rows), folder, batch)
    return sink


def last_saved(profiles: DataFrame) -> DataFrame:
    """The newest row per user; of rows with one time the one that is last in the order of its columns."""
    columns = [c for c in profiles.columns if c != "user_id"]
    newest = F.struct("updated_at", *[c for c in columns if c != "updated_at"])
    return profiles.groupBy("user_id").agg(F.max_by(F.struct(*columns), newest).alias("p")).select("user_id", "p.*")


def profile_sink(folder: str, every: int = EVERY) -> Callable[[DataFrame, int], None]:
    """Last save wins: a snapshot and the saves of the batches since, one row per user each."""
    return FoldedState(folder, last_saved, every).sink


def current_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return FoldedState(folder, last_saved).current(spark)
