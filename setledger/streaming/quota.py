"""The daily quota as keyed state: one state per block of users and day, dropped by a timer.

A prompt is answered in the batch in which it arrives. Users are dealt into ``BLOCKS`` blocks by a hash; the state of a block and
day is the list of its accepted (user, event), at most ``limit`` of each user, so a prompt that is delivered twice is not counted
twice, and no batch looks at earlier output. A call per user and day would cost some milliseconds each; a block answers all of its
users' prompts at once, on arrays. Spark keeps the states (RocksDB, changes only) and restores them with the checkpoint; a
batch that is run again starts from the state before it. Within a batch each user's first prompts by (time, event id) come first.
Rows of a busy user and day are read as they come: the task holds ``limit`` of each user.

A timer drops a day's state once event time has passed the end of the day by ``grace``. Prompts may arrive late by as
much; later ones are not answered (Spark reports their number as dropped by the watermark).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from setledger.functions.vocabulary import DAILY_PROMPTS

GRACE = timedelta(days=2)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
CHANGELOG_KEY = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
PARTITIONS_KEY = "spark.sql.shuffle.partitions"
# Blocks of users, and the most tasks of a batch (each opens a store of its own). Both stay as they are for a checkpoint.
BLOCKS = 256
STATE_PARTITIONS = 48

ANSWERS = "event_id bigint, user_id bigint, day date, allowed boolean, used bigint"
# Stands for a missing user, and before every time.
LEAST = -2**63
USER, AT, EVENT = range(3)


def in_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (user, time, event), each event of a user once, by user, time and event; and their places among their user's."""
    rows = rows[np.lexsort((rows[:, AT], rows[:, EVENT], rows[:, USER]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:, USER] == rows[:-1, USER]) & (rows[1:, EVENT] == rows[:-1, EVENT])
    rows = rows[~again]
    rows = rows[np.lexsort((rows[:, EVENT], rows[:, AT], rows[:, USER]))]
    return rows, np.arange(len(rows)) - np.searchsorted(rows[:, USER], rows[:, USER])


class DailyQuota(StatefulProcessor):
    """Answers the prompts of one (block of users, day)."""

    def __init__(self, limit: int, grace: timedelta) -> None:
        self.limit, self.grace = limit, grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.accepted = handle.getValueState("accepted", "pairs binary")  # (user, event) as 64-bit integers

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.accepted.get()
        pairs = np.frombuffer(held[0] if held else b"", np.int64).reshape(-1, 2)
        if not held:
            ends = datetime(key[1].year, key[1].month, key[1].day, tzinfo=timezone.utc) + timedelta(days=1) + self.grace
            self.handle.registerTimer(int(ends.timestamp() * 1000))
        # accepted prompts keep their places: they come before any time
        kept = np.stack([pairs[:, 0], LEAST + np.arange(len(pairs), dtype=np.int64), pairs[:, 1]], axis=1)
        place = np.empty(0, np.int64)
        for part in rows:
            new = np.stack([part[c].to_numpy(np.int64) for c in ("user_id", "micros", "event_id")], axis=1)
            kept, place = in_order(np.concatenate([kept, new]))
            late = place >= self.limit
            if late.any():
                yield self._answers(key[1], kept[late], allowed=False, used=self.limit)
            kept, place = kept[~late], place[~late]
        first = kept[:, AT] >= LEAST + len(pairs)
        if first.any():
            yield self._answers(key[1], kept[first], allowed=True, used=place[first] + 1)
        if first.any() or not held:
            self.accepted.update((kept[:, [USER, EVENT]].tobytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.accepted.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _answers(day, rows: np.ndarray, allowed: bool, used) -> pd.DataFrame:
        return pd.DataFrame({"event_id": rows[:, EVENT], "user_id": rows[:, USER], "day": day, "allowed": allowed, "used": used})


def quota_answers(prompts: DataFrame, limit: int = DAILY_PROMPTS, grace: timedelta = GRACE) -> DataFrame:
    """A stream of (event_id, user_id, ts) to one of answers."""
    at, user = F.col("ts").cast("timestamp"), F.coalesce(F.col("user_id").cast("bigint"), F.lit(LEAST))
    keyed = prompts.select("event_id", user.alias("user_id"), F.pmod(F.xxhash64(user), F.lit(BLOCKS)).alias("block"), at.alias("at"),
                           F.to_date("ts").alias("day"), F.unix_micros(at).alias("micros"))
    seconds = int(grace.total_seconds())
    answers = (keyed.withWatermark("at", f"{seconds} seconds").groupBy("block", "day")
               .transformWithStateInPandas(DailyQuota(limit, grace), ANSWERS, "Append", "EventTime"))
    return answers.withColumn("user_id", F.nullif("user_id", F.lit(LEAST)))


def start_quota(prompts: DataFrame, folder: str, checkpoint: str, limit: int = DAILY_PROMPTS, grace: timedelta = GRACE,
                once: bool = True) -> StreamingQuery:
    """Answer the prompts that are there (or all that come, with ``once=False``) into Parquet files under ``folder``."""
    spark = prompts.sparkSession
    partitions = min(int(spark.conf.get(PARTITIONS_KEY)), STATE_PARTITIONS)
    wanted = {PROVIDER_KEY: ROCKSDB, CHANGELOG_KEY: "true", PARTITIONS_KEY: str(partitions)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:  # a stream keeps the settings it was started with
        writer = (quota_answers(prompts, limit, grace).writeStream.format("parquet").outputMode("append")
                  .option("path", folder).option("checkpointLocation", checkpoint))
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """One answer per prompt: a rejected prompt that was delivered again got the same answer again."""
    return spark.read.schema(ANSWERS).parquet(folder).dropDuplicates(["event_id"])
