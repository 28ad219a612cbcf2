"""The stored retrieval index: chunk table, vector table, manifest; joined by key, not position.

Two layouts are read alike. ``write_index`` stores one pair of tables. ``stage`` and ``commit`` keep an index that grows
in versions::

    parts/chunks/<n>, parts/vectors/<n>   what version n added
    docs/<n>                              the documents of version n, each with its stamp and number of chunks
    dead/<n>                              keys of chunks in older parts that version n does not hold any more
    manifest/<n>                          settings, counts and the parts that version n consists of
    commits/<n>                           written last: without it, none of the above counts
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from setledger.functions.vocabulary import CHUNK_OVERLAP, CHUNK_WORDS
from setledger.operators.documents import index_stats
from setledger.sources.files import numbered, put_marker, remove

DEFAULT_ENCODER = "hashed"
MANIFEST = T.StructType([
    T.StructField("encoder", T.StringType()),
    T.StructField("chunk_size_words", T.IntegerType()),
    T.StructField("chunk_overlap_words", T.IntegerType()),
    T.StructField("num_files", T.LongType()),
    T.StructField("num_chunks", T.LongType()),
])
VERSION_MANIFEST = T.StructType([*MANIFEST.fields, T.StructField("parts", T.ArrayType(T.IntegerType())),
                                 T.StructField("num_dead", T.LongType())])


def write_index(chunks: DataFrame, vectors: DataFrame, folder: str, encoder: str = DEFAULT_ENCODER,
                size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, doc_key: str = "doc_id") -> None:
    spark = chunks.sparkSession
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    vectors.select("chunk_key", "embedding").write.mode("overwrite").parquet(f"{folder}/vectors")
    stored = spark.read.schema(chunks.schema).parquet(f"{folder}/chunks")
    manifest = index_stats(stored, doc_key).select(
        F.lit(encoder).alias("encoder"), F.lit(size).alias("chunk_size_words"),
        F.lit(overlap).alias("chunk_overlap_words"), "num_files", "num_chunks")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")


def index_orphans(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keys that only one side has, with the side."""
    no_vector = chunks.join(vectors, "chunk_key", "left_anti").select("chunk_key", F.lit("chunk").alias("side"))
    no_chunk = vectors.join(chunks, "chunk_key", "left_anti").select("chunk_key", F.lit("vector").alias("side"))
    return no_vector.unionByName(no_chunk)


def read_index(spark: SparkSession, folder: str, check: bool = True) -> tuple[DataFrame, DataFrame, str]:
    """Chunks, vectors and encoder name; absent tables, unmatched rows and a wrong chunk count are errors."""
    manifest = read_manifest(spark, folder)
    if manifest is not None and "parts" in manifest:
        chunks, vectors = (_live(spark, folder, part) for part in ("chunks", "vectors"))
    else:
        chunks, vectors = (spark.read.parquet(f"{folder}/{part}") for part in ("chunks", "vectors"))
    if check:
        if not index_orphans(chunks.select("chunk_key"), vectors.select("chunk_key")).isEmpty():
            raise ValueError("index holds chunks without vectors or vectors without chunks")
        if manifest is not None and manifest["num_chunks"] != chunks.count():
            raise ValueError("index holds another number of chunks than its manifest says")
    return chunks, vectors, (manifest["encoder"] if manifest and manifest["encoder"] else DEFAULT_ENCODER)


def read_manifest(spark: SparkSession, folder: str) -> Row | None:
    version = committed(spark, folder)
    if version is None:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").first()
    return spark.read.schema(VERSION_MANIFEST).parquet(f"{folder}/manifest/{version}").first()


def joined_index(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.join(vectors, "chunk_key", "inner")


# ---- versions


def committed(spark: SparkSession, folder: str) -> int | None:
    """The newest version that counts."""
    return max(numbered(spark, f"{folder}/commits"), default=None)


def documents_of(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/docs/{version}")


def stage(rows: DataFrame, folder: str, part: str, version: int) -> DataFrame:
    """Store one table of a version to come, in place of what a broken run may have left there."""
    path = f"{folder}/{part}/{version}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def commit(spark: SparkSession, folder: str, version: int, parts: Sequence[int], encoder: str = DEFAULT_ENCODER,
           size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> None:
    """Describe the staged tables, then let them count. Two versions stay; what only older ones need is removed."""
    counts = documents_of(spark, folder, version).agg(
        F.count_if(F.col("n_chunks") > 0).alias("files"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).first()
    dead = spark.read.parquet(f"{folder}/dead/{version}").count()
    row = (encoder, size, overlap, counts["files"], counts["chunks"], list(parts), dead)
    stage(spark.createDataFrame([row], VERSION_MANIFEST).coalesce(1), folder, "manifest", version)
    put_marker(spark, f"{folder}/commits/{version}")
    kept = numbered(spark, f"{folder}/commits")[-2:]
    needed = {p for v in kept for p in spark.read.schema(VERSION_MANIFEST).parquet(f"{folder}/manifest/{v}").first()["parts"]}
    for name, still in [("commits", kept), ("manifest", kept), ("docs", kept), ("dead", kept),
                        ("parts/chunks", needed), ("parts/vectors", needed)]:
        for number in numbered(spark, f"{folder}/{name}"):
            if number not in still:
                remove(spark, f"{folder}/{name}/{number}")


def _live(spark: SparkSession, folder: str, part: str) -> DataFrame:
    version = committed(spark, folder)
    manifest = read_manifest(spark, folder)
    tables = [spark.read.parquet(f"{folder}/parts/{part}/{n}").withColumn("part", F.lit(n)) for n in manifest["parts"]]
    rows = reduce(DataFrame.unionByName, tables)
    if not manifest["num_dead"]:
        return rows
    return rows.join(spark.read.parquet(f"{folder}/dead/{version}"), "chunk_key", "left_anti")
