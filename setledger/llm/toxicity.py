"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams (A-Z and other letters lower-cased, white space folded) is counted
per class over *all* labelled training rows; the smoothed log ratio of the two class frequencies scales
each feature, and a logistic model is fitted on the scaled features. The fit itself takes a bounded
sample of labelled texts (``rows_per_class``, about that many distinct ones of each class, chosen by a
hash of the text); the vector of counts has ``2 ** bits`` entries whatever the corpus is.

Defined results: null or empty text has no n-gram and gets the score of the intercept; repeated rows get
equal scores and count each in the ratios, but once in the fit, so that a text with any number of copies
is one row of the sample; several label rows of one document count once, as toxic if one of them says so; labels
without a document and null labels are ignored; with no training rows, or none of one class, every score
is 0.0. Columns besides doc_id, text and toxic are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from setledger.llm.common import code_points, held_out, slices
from setledger.session import pin

ORDERS = (5, 6, 7)
BITS = 18
ROWS_PER_CLASS = 2_500
MAX_FEATURES = 20_000
THRESHOLD = 0.7
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(1_000_003)


def _normal(text: str | None) -> str:
    return f" {' '.join(text.lower().split())} " if text else ""


def features(texts: list[str | None], bits: int = BITS) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text, from its whole length."""
    points, starts = code_points([_normal(t) for t in texts])
    points = points.astype(np.uint64)
    rolled, hashed = points.copy(), []
    for order in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * _BASE + points[order - 1:] if len(points) >= order else rolled[:0]
        if order in ORDERS:
            hashed.append((order, ((rolled + np.uint64(order)) * _MIX >> np.uint64(64 - bits)).astype(np.int32)))
    mark = np.zeros(1 << bits, np.int32)
    for start, end in zip(starts[:-1], starts[1:]):
        own = np.concatenate([h[start:max(start, end - order + 1)] for order, h in hashed])
        place = np.arange(len(own), dtype=np.int32)
        mark[own] = place
        yield own[mark[own] == place]


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the labelled rows that are not held out, stored once. Labels grow with the corpus, so
    the join is the one for large tables at every size."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(~held_out(F.col("doc_id")))
    return pin(docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"))).join(
        marks.hint("merge"), "doc_id").select(
        "text", (F.col("toxic") > 0).cast("int").alias("toxic")))


def presence_counts(rows: DataFrame, bits: int = BITS) -> pd.DataFrame:
    """(feature, toxic, clean): in how many rows of each class a feature occurs. Counts are added up in
    each task and then by feature; the result has at most ``2 ** bits`` rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for toxic, found in zip(part["toxic"].to_numpy(), features(part["text"].tolist(), bits)):
                    sums[toxic, found] += 1
        at = np.flatnonzero(sums.sum(axis=0)).astype(np.int32)
        yield pd.DataFrame({"feature": at, "toxic": sums[1, at], "clean": sums[0, at]})

    return rows.mapInPandas(count, "feature int, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()


@dataclass
class ToxicityModel:
    weights: np.ndarray  # float32, one per feature; already scaled by the log-count ratio
    intercept: float


def log_ratios(counts: pd.DataFrame, rows: tuple[int, int], bits: int, keep: int) -> np.ndarray:
    """Smoothed log ratio of the class frequencies; zero for all but the ``keep`` features whose ratio
    is the most standard errors away from zero."""
    clean, toxic = rows
    p, q = counts["toxic"].to_numpy() + 0.5, counts["clean"].to_numpy() + 0.5
    ratio = np.log(p / (toxic + 1.0)) - np.log(q / (clean + 1.0))
    sure = np.abs(ratio) / np.sqrt(1.0 / p + 1.0 / q)
    order = np.lexsort((counts["feature"].to_numpy(), -sure))[:keep]
    out = np.zeros(1 << bits)
    out[counts["feature"].to_numpy()[order]] = ratio[order]
    return out


def fit_logistic(rows: list[np.ndarray], marks: np.ndarray, ratio: np.ndarray, rounds: int = 400,
                 penalty: float = 2e-4) -> ToxicityModel:
    """Logistic loss with equal weight for both classes, by accelerated gradient steps."""
    kept = [r[ratio[r] != 0] for r in rows]
    columns = np.concatenate(kept)
    lines = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    values = ratio[columns]
    weight = np.where(marks == 1, 0.5 / max(1, (marks == 1).sum()), 0.5 / max(1, (marks == 0).sum()))
    norms = np.bincount(lines, values ** 2, len(kept)) + 1.0
    step = 4.0 / (np.sum(weight * norms) + penalty)
    w, b = np.zeros(len(ratio)), 0.0
    vw, vb, momentum = w, b, 1.0
    for _ in range(rounds):
        z = np.bincount(lines, values * vw[columns], len(kept)) + vb
        slope = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))) - marks)
        new_w = vw - step * (np.bincount(columns, values * slope[lines], len(ratio)) + penalty * vw)
        new_b = vb - step * slope.sum()
        ahead = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        vw, vb = new_w + (momentum - 1) / ahead * (new_w - w), new_b + (momentum - 1) / ahead * (new_b - b)
        w, b, momentum = new_w, new_b, ahead
    return ToxicityModel((w * ratio).astype(np.float32), float(b))


def train_toxicity(docs: DataFrame, labels: DataFrame, bits: int = BITS, rows_per_class: int = ROWS_PER_CLASS,
                   max_features: int = MAX_FEATURES) -> ToxicityModel:
    """``rows_per_class`` bounds the rows of the fit; the log-count ratios take all labelled rows."""
    rows = labelled_rows(docs, labels)
    by_text = F.xxhash64(F.coalesce("text", F.lit("")))
    classes = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.approx_count_distinct(by_text, 0.01).alias("texts")).collect()
    sizes = {r["toxic"]: r["n"] for r in classes}
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(1 << bits, np.float32), -np.inf)
    ratio = log_ratios(presence_counts(rows, bits), (sizes[0], sizes[1]), bits, max_features)
    share = {r["toxic"]: min(1.0, rows_per_class / max(1, r["texts"])) for r in classes}
    drawn = F.pmod(by_text, F.lit(1 << 40)) < F.when(
        F.col("toxic") == 1, int(share[1] * (1 << 40))).otherwise(int(share[0] * (1 << 40)))

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [f[ratio[f] != 0] for f in features(part["text"].tolist(), bits)]
                yield pd.DataFrame({"toxic": part["toxic"].to_numpy(), "found": [np.sort(f).tobytes() for f in found]})

    sample = rows.filter(drawn).mapInPandas(chosen, "toxic int, found binary").distinct().toPandas()
    sample = sample.sort_values(["toxic", "found"], kind="stable")
    if sample["toxic"].nunique() < 2:
        return ToxicityModel(np.zeros(1 << bits, np.float32), -np.inf)
    return fit_logistic([np.frombuffer(x, np.int32) for x in sample["found"]], sample["toxic"].to_numpy(), ratio)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on). Other columns stay."""
    bits = int(len(model.weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, intercept = shared.value.weights, shared.value.intercept
        for batch in batches:
            for part in slices(batch, "text"):
                z = np.array([intercept + float(weights[f].sum(dtype=np.float64)) for f in features(part["text"].tolist(), bits)])
                yield part.assign(score=np.round(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))), 9) * np.isfinite(z))

    kept = docs.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(score, schema + ", score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
