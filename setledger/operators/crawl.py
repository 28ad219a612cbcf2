"""Jobs over link lists, crawl logs and stored pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from setledger.functions.markers import is_block_error, is_transcript_block
from setledger.operators.ordering import with_neighbours


def skip_existing(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Sources that were not processed yet."""
    return targets.join(done.select(key), key, "left_anti")


def crawl_outcomes(log: DataFrame, transcripts: bool = False) -> DataFrame:
    """Each fetch as a success (no message), a block, or some other error. Transcript services word their blocks
    in their own way."""
    blocked = is_transcript_block if transcripts else is_block_error
    return log.withColumns({"success": F.col("message").isNull(), "blocked": blocked(F.col("message"))})


def first_stop(log: DataFrame, limit: int, keys: Sequence[str] = ("site",), order: str = "seq",
               transcripts: bool = False) -> DataFrame:
    """Where fetching stops for each key: the ``limit``-th block since the last success.

    A success resets the count, any other error leaves it as it is. With only blocks and successes kept in order, a stop is a row whose last ``limit`` rows are
    all blocks; that needs a frame of fixed length instead of a running count.
    """
    events = crawl_outcomes(log, transcripts).filter(F.col("blocked") | F.col("success"))

    def look_back(df: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(1 - limit, 0)
        return df.withColumn("_run", F.sum(F.col("blocked").cast("int")).over(frame))

    runs = with_neighbours(events, keys, [order], look_back, before=limit - 1)
    stops = runs.filter(F.col("_run") >= limit)
    return stops.groupBy(*keys).agg(F.min(order).alias("stop_at"))


def join_transcript(entries: DataFrame, key: str, position: str = "turn", text: str = "text") -> DataFrame:
    """The entries of each transcript as one text, in order.

    The result is one value per transcript, so a transcript must fit a row; that is a property of
    the output, not of how many transcripts there are.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t"))))
    return entries.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("transcript"))
