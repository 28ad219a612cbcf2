"""Text compositions: corpus to index, questions to context."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from setledger.functions.vocabulary import CHUNK_OVERLAP, CHUNK_WORDS, TOP_K
from setledger.operators.coaching import context_blocks
from setledger.operators.documents import chunk_words, parse_header
from setledger.operators.retrieval import retrieve
from setledger.operators.vectorize import fit_hashed_vectorizer, hashed_vectors
from setledger.session import pin
from setledger.sources import index

#: Share of dead chunks beyond which the next update writes the index anew.
COMPACT_FROM = 0.2


def chunk_corpus(corpus: DataFrame, doc_order: Sequence[str], size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP,
                 stamp: str | None = None, salt: int = 0) -> DataFrame:
    """Stored documents (raw_text) to chunks with their header fields and a key that follows from the document, its
    content (or ``stamp``, a column that changes with it), the place of the chunk and ``salt``. No shuffle; running
    numbers, where they are wanted, come from ``chunk_numbers``."""
    stamped = corpus.withColumn("stamp", content_stamp(stamp))
    chunks = chunk_words(parse_header(stamped), size, overlap)
    return chunks.withColumn("chunk_key", F.xxhash64(*doc_order, "stamp", "chunk_index", F.lit(salt)))


def content_stamp(stamp: str | None = None) -> Column:
    return F.sha2("raw_text", 256) if stamp is None else F.col(stamp).cast("string")


def update_index(corpus: DataFrame, doc_order: Sequence[str], folder: str, vectorize: Callable[[DataFrame], DataFrame],
                 encoder: str = index.DEFAULT_ENCODER, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP,
                 stamp: str | None = None, anew: bool = False) -> int:
    """Bring the index in ``folder`` up to the corpus and return its version.

    Documents are compared by key and stamp; only new and changed ones are parsed, chunked and given vectors
    (``vectorize``: chunks to chunk_key and embedding). Chunks of changed and absent documents are named dead. The tables of a
    version are stored first and its commit mark last, so a run that breaks off leaves the version before it as it
    is. Nothing to do makes no version; other chunk settings or another encoder make the index ``anew``.
    """
    spark, keys = corpus.sparkSession, [*doc_order, "stamp"]
    last = index.committed(spark, folder)
    before = index.read_manifest(spark, folder) if last is not None and not anew else None
    if before is not None and (before["encoder"], before["chunk_size_words"], before["chunk_overlap_words"]) != (encoder, size, overlap):
        before = None
    version, parts = (0 if last is None else last + 1), list(before["parts"]) if before else []
    stamped = corpus.withColumn("stamp", content_stamp(stamp))
    listing = pin(stamped.select(keys))
    fresh, texts, known = listing, stamped, None
    if before:
        known = index.documents_of(spark, folder, last)
        fresh = pin(listing.join(known, keys, "left_anti"))
        gone = pin(known.filter("n_chunks > 0").join(listing, keys, "left_anti").select(keys))
        if fresh.isEmpty() and known.count() == listing.count():
            return last
        texts = stamped.join(fresh, keys, "left_semi")
    chunks = index.stage(chunk_corpus(texts, doc_order, size, overlap, "stamp", version), folder, "parts/chunks", version)
    index.stage(vectorize(chunks).select("chunk_key", "embedding"), folder, "parts/vectors", version)
    counts = chunks.groupBy(keys).agg(F.count("*").alias("n_chunks"))
    added = fresh.join(counts, keys, "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    docs = added if known is None else added.unionByName(known.join(listing, keys, "left_semi"))
    total = index.stage(docs, folder, "docs", version).agg(F.sum("n_chunks")).first()[0] or 0
    dead = spark.createDataFrame([], "chunk_key bigint")
    if known is not None:
        earlier = spark.read.parquet(*[f"{folder}/parts/chunks/{n}" for n in parts])
        dead = earlier.join(gone, keys, "left_semi").select("chunk_key").union(spark.read.parquet(f"{folder}/dead/{last}")).distinct()
    dead = index.stage(dead, folder, "dead", version)
    if before and dead.count() > COMPACT_FROM * total:
        _rewrite(spark, folder, version, parts)
        parts = []
    parts.append(version)
    _check_keys(spark, folder, parts)
    index.commit(spark, folder, version, parts, encoder, size, overlap)
    return version


def _rewrite(spark: SparkSession, folder: str, version: int, parts: Sequence[int]) -> None:
    """One part with the living chunks of all parts, the new ones included, in place of the new part."""
    dead = spark.read.parquet(f"{folder}/dead/{version}")
    for name in ("chunks", "vectors"):
        rows = spark.read.parquet(*[f"{folder}/parts/{name}/{n}" for n in [*parts, version]])
        index.stage(pin(rows.join(dead, "chunk_key", "left_anti")), folder, f"parts/{name}", version)
    index.stage(dead.limit(0), folder, "dead", version)


def _check_keys(spark: SparkSession, folder: str, parts: Sequence[int]) -> None:
    """Keys are hashes: two chunks with one key are an error, not one chunk."""
    keys = spark.read.parquet(*[f"{folder}/parts/chunks/{n}" for n in parts]).groupBy("chunk_key").count()
    if not keys.filter("count > 1").isEmpty():
        raise ValueError("two chunks have the same key; documents repeat, or the hash does")


def build_index(corpus: DataFrame, doc_order: list[str], folder: str, dim: int = 512) -> PipelineModel:
    """Parse, chunk, vectorize and store; returns the vectorizer for queries. The texts are cut once: the vectorizer
    is fitted on the chunks as they are stored."""
    fitted: list[PipelineModel] = []

    def vectorize(chunks: DataFrame) -> DataFrame:
        fitted.append(fit_hashed_vectorizer(chunks, dim=dim))
        return hashed_vectors(chunks, fitted[0])

    update_index(corpus, doc_order, folder, vectorize, anew=True)
    return fitted[0]


def answer_contexts(questions: DataFrame, model: PipelineModel, vectors: DataFrame, chunks: DataFrame,
                    workouts: DataFrame, profiles: DataFrame, learned: DataFrame | None = None,
                    top_k: int = TOP_K) -> DataFrame:
    """Context text of every question, vectors of the questions included."""
    queries = hashed_vectors(questions, model, "question", "query_vec").select(
        F.col("question_id").alias("query_id"), "query_vec", F.col("question").alias("query_text"))
    found = retrieve(queries, vectors, chunks, top_k)
    return context_blocks(questions, found, workouts, profiles, learned)
