"""The newest row of every key, kept as a snapshot plus the changes of the batches since.

Each batch writes one row per changed key (``delta/<batch>``). Every ``every`` batches, snapshot and deltas are folded
into a new snapshot (``snapshot/<batch>``), which counts once its marker stands in ``versions/``. Then all that the
version before the last one needed is removed. A reader takes the newest marked version and the deltas after it: at
most one snapshot and ``2 * every`` deltas, however many batches there were.

A batch that runs again writes the same delta in place of the first one and does not fold twice; a fold that broke off before
its marker is done again by the next fold. The version before the newest one stays, for readers that started on it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from setledger.sources.files import numbered, put_marker, remove

EVERY = 8


@dataclass(frozen=True)
class FoldedState:
    """``newest`` maps rows to one row per key, in the same columns; it may be applied again to its own results."""

    folder: str
    newest: Callable[[DataFrame], DataFrame]
    every: int = EVERY

    def sink(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        self.newest(rows).write.mode("overwrite").parquet(f"{self.folder}/delta/{batch}")
        if (batch + 1) % self.every == 0:
            self.fold(spark, batch)

    def paths(self, spark: SparkSession, upto: int | None = None) -> list[str]:
        """What a reader needs, up to a batch: the newest snapshot and the deltas after it."""
        versions = [v for v in numbered(spark, f"{self.folder}/versions") if upto is None or v <= upto]
        since = versions[-1] if versions else -1
        deltas = [d for d in numbered(spark, f"{self.folder}/delta") if d > since and (upto is None or d <= upto)]
        return [f"{self.folder}/snapshot/{v}" for v in versions[-1:]] + [f"{self.folder}/delta/{d}" for d in deltas]

    def fold(self, spark: SparkSession, batch: int) -> None:
        versions = numbered(spark, f"{self.folder}/versions")
        if batch not in versions:
            folded = self.newest(self._read(spark, self.paths(spark, batch)))
            folded.write.mode("overwrite").parquet(f"{self.folder}/snapshot/{batch}")
            put_marker(spark, f"{self.folder}/versions/{batch}")
        kept = max((v for v in versions if v < batch), default=-1)
        for part in ("versions", "snapshot", "delta"):
            for number in numbered(spark, f"{self.folder}/{part}"):
                if number < kept or (part == "delta" and number == kept):
                    remove(spark, f"{self.folder}/{part}/{number}")

    def current(self, spark: SparkSession) -> DataFrame:
        """One row per key. Without any batch there is nothing to read, which is an error."""
        return self.newest(self._read(spark, self.paths(spark)))

    @staticmethod
    def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
        if not paths:
            raise ValueError("no batch was stored yet")
        schema = spark.read.parquet(paths[-1]).schema  # one footer; all parts have the same columns
        return spark.read.schema(schema).parquet(*paths)
