"""Session builder, shared scratch space and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Paths handed out by ``scratch_path`` since the start or the last ``drop_scratch``.
_scratch: list[str] = []


def build_session(app: str = "setledger", cores: str | int | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    ``cores`` is only for local runs; on a cluster leave it out and let spark-submit choose the
    master. Shuffle partitions start high there and AQE coalesces them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if cores is not None:
        builder = (builder.master(f"local[{cores}]")
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false")
                   .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g")))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session may fall back to a folder of its own.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
    own = tempfile.mkdtemp(prefix="setledger-")
    spark.conf.set(CHECKPOINT_KEY, own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table that a job writes and reads back."""
    path = f"{shared_dir(spark).rstrip('/')}/setledger/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch paths that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def drop_scratch(spark: SparkSession) -> int:
    """Remove the tables that this process has stored under the shared folder, once a job has written its result;
    returns how many paths there were. Frames that still read them must not be used any more."""
    drop_paths(spark, _scratch)
    count = len(_scratch)
    _scratch.clear()
    return count


def pin(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from it.

    Used where rows are looked at more than once, or where two branches must see the same values
    of a column that depends on the physical layout. It cuts the lineage, survives the loss of
    executors, and later steps read only the columns they need. With ``by``, a column of few values, they also read
    only the folders of the values they ask for.
    """
    path = scratch_path(df.sparkSession, "pinned")
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
