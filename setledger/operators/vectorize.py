"""Text and vector tables to unit vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from setledger.functions.vectors import l2_normalize

ENCODE_BATCH = 32


def mean_pool(vectors: DataFrame, key: str | Sequence[str], vector: str = "embedding",
              mask: str = "mask") -> DataFrame:
    """Mask-weighted mean of the vectors of each key, at unit length.

    Vector sums are combined on the map side, one running vector per key. A key without any
    unmasked vector gets zeros.
    """
    keys = [key] if isinstance(key, str) else list(key)
    weight = F.col(mask).cast("double")
    weighted = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.col("_w"))
    sums = (vectors.withColumn("_w", weight)
            .select(*keys, "_w", array_to_vector(weighted).alias("_v"))
            .groupBy(*keys)
            .agg(Summarizer.sum(F.col("_v")).alias("_s"), F.sum("_w").alias("_n")))
    floor = F.greatest("_n", F.lit(1e-9))
    pooled = F.transform(vector_to_array("_s"), lambda x: x / floor)
    return sums.select(*keys, l2_normalize(pooled).alias(vector))


def fit_hashed_vectorizer(texts: DataFrame, column: str = "text", dim: int = 512,
                          min_docs: int = 0) -> PipelineModel:
    """Built-in stand-in for a pretrained encoder: hashed word counts, weighted by rarity, at
    unit length. Fitting counts documents per hashed word: one aggregate of fixed width."""
    tokens = texts.select(F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9]+)")).alias("_tokens"))
    counts = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim)
    rarity = IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=min_docs)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0)
    return Pipeline(stages=[counts, rarity, unit]).fit(tokens)


def hashed_vectors(texts: DataFrame, model: PipelineModel, column: str = "text",
                   output: str = "embedding") -> DataFrame:
    tokens = texts.withColumn("_tokens", F.regexp_extract_all(F.lower(column), F.lit("([a-z0-9]+)")))
    return (model.transform(tokens).withColumn(output, vector_to_array("_unit"))
            .drop("_tokens", "_tf", "_tfidf", "_unit"))


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], column: str = "text",
           output: str = "embedding") -> DataFrame:
    """Vectors from a user's own encoder, called on executors with batches of texts.

    ``encoder`` maps a list of texts to a (rows, dim) array; load heavy models lazily inside it.
    """
    schema = T.StructType([*texts.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for start in range(0, len(frame), ENCODE_BATCH):
                part = frame.iloc[start:start + ENCODE_BATCH]
                raw = np.asarray(encoder(part[column].tolist()), dtype=np.float64)
                norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
                yield part.assign(**{output: list((raw / norm).astype(np.float32))})

    return texts.mapInPandas(run, schema)
