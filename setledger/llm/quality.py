"""Quality rules: an isolation forest on rule statistics, with a threshold calibrated on labelled rows.

Every document gets a row of rule statistics from its whole text. Random axis-parallel splits isolate
anomalous rows after few steps; the mean path length over all trees, on the usual scale
``2 ** (-path / c(rows per tree))``, is the anomaly score. Each tree is grown on a bounded sample of
documents, as the method asks (``trees * rows_per_tree`` rows, chosen by a hash); the threshold comes
from the score counts of all labelled rows.

Defined results: null or blank text has no words and fails the base rules; several label rows of one
document count each; without usable labels only the base rules reject; an empty table gives an empty
result; columns besides doc_id, text and quality are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from setledger.llm.common import BLANK_WORDS, slices
from setledger.session import pin

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TREES = 100
ROWS_PER_TREE = 256
#: At most this share of the labelled good rows may score beyond the threshold.
GOOD_ROWS_LOST = 0.02
BINS = 2_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_capitals", "n_distinct_words", "n_marks", "n_long_words"]


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)[1]
    _, which, times = np.unique(pair * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def rule_statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS, then MORE."""
    text = text or ""
    words = BLANK_WORDS.findall(text)
    lines = [x for x in text.split("\n") if BLANK_WORDS.search(x)]
    chars = sum(map(len, words))
    kinds = Counter(text)
    capitals = sum(n for c, n in kinds.items() if c.isupper())
    marks = sum(n for c, n in kinds.items() if not c.isalnum() and not c.isspace())
    return (len(words), chars, sum(kinds[c] for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
            len(lines), capitals, len(set(words)), marks, sum(len(w) > 18 for w in words))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics, one row per document, stored once."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.array([rule_statistics(t) for t in part["text"]], np.int64).reshape(len(part), -1)
                yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(found, columns=COUNTS + MORE)], axis=1)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS + MORE)
    return pin(docs.select("doc_id", "text").mapInPandas(measure, schema))


def rates(rows: pd.DataFrame) -> np.ndarray:
    """The forest's coordinates: counts per word or line, so that length itself is no anomaly."""
    words, lines = np.maximum(rows["n_words"], 1), np.maximum(rows["n_lines"], 1)
    return np.stack([rows["word_chars"] / words, rows["n_symbols"] / words, rows["n_dup_lines"] / lines,
                     rows["n_repeat_words"] / words, rows["n_capitals"] / np.maximum(rows["word_chars"], 1),
                     rows["n_marks"] / words, rows["n_long_words"] / words,
                     rows["n_distinct_words"] / words ** 0.8], axis=1).astype(np.float64)


@dataclass
class IsolationForest:
    column: np.ndarray  # (trees, nodes); -1 in a leaf
    split: np.ndarray
    path: np.ndarray  # depth plus the expected rest, in leaves
    scale: float


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


def grow_forest(points: np.ndarray, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE, seed: int = 17) -> IsolationForest:
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(max(2, rows_per_tree))))
    nodes = 2 ** (depth + 1) - 1
    forest = IsolationForest(np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes)),
                             float(expected_path(np.array(min(rows_per_tree, len(points))))) or 1.0)
    for t in range(trees):
        todo = [(0, 0, points[rng.choice(len(points), min(rows_per_tree, len(points)), replace=False)])]
        while todo:
            node, level, own = todo.pop()
            low, high = own.min(axis=0), own.max(axis=0)
            open_columns = np.flatnonzero(high > low)
            if level == depth or not len(open_columns):
                forest.path[t, node] = level + expected_path(np.array(len(own)))
                continue
            column = int(rng.choice(open_columns))
            cut = rng.uniform(low[column], high[column])
            left = own[:, column] <= cut
            forest.column[t, node], forest.split[t, node] = column, cut
            todo += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
    return forest


def anomaly(forest: IsolationForest, points: np.ndarray) -> np.ndarray:
    total, rows = np.zeros(len(points)), np.arange(len(points))
    for column, split, path in zip(forest.column, forest.split, forest.path):
        node = np.zeros(len(points), np.int64)
        while True:
            on = column[node]
            inner = on >= 0
            if not inner.any():
                break
            node = np.where(inner, 2 * node + 1 + (points[rows, np.maximum(on, 0)] > split[node]), node)
        total += path[node]
    return 2.0 ** (-total / len(forest.column) / forest.scale)


def fit_forest(statistics: DataFrame, trees: int = TREES, rows_per_tree: int = ROWS_PER_TREE) -> IsolationForest | None:
    """The sample is the ``trees * rows_per_tree`` rows, about, with the smallest hash of their statistics
    and id; it is the only thing gathered."""
    want, rows = trees * rows_per_tree, statistics.filter("n_words > 0").count()
    if not rows:
        return None
    share = min(1.0, want / rows)
    drawn = F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = statistics.filter("n_words > 0").filter(drawn).select(*COUNTS, *MORE).toPandas()
    if sample.empty:
        return None
    return grow_forest(rates(sample.sort_values(COUNTS + MORE)), trees, rows_per_tree)


def with_anomaly(statistics: DataFrame, forest: IsolationForest | None) -> DataFrame:
    if forest is None:
        return statistics.withColumn("anomaly", F.lit(0.0))
    shared = statistics.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(anomaly=np.round(anomaly(shared.value, rates(batch)), 9))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in statistics.schema.fields)
    return statistics.mapInPandas(score, schema + ", anomaly double")


def calibrated_threshold(scored: DataFrame, labels: DataFrame, lost: float = GOOD_ROWS_LOST) -> float:
    """The score that parts labelled bad from good rows best (rejected bad share minus rejected good
    share) among those that reject at most ``lost`` of the good ones; 2.0 (nothing) without labels."""
    marks = labels.filter("quality IS NOT NULL").select("doc_id", (F.col("quality") > 0).cast("int").alias("good"))
    counts = scored.join(marks, "doc_id").groupBy(F.floor(F.col("anomaly") * BINS).alias("bin")).agg(
        F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad")).toPandas().sort_values("bin", ascending=False)
    if counts.empty or not counts["good"].sum() or not counts["bad"].sum():
        return 2.0
    good, bad = counts["good"].cumsum() / counts["good"].sum(), counts["bad"].cumsum() / counts["bad"].sum()
    gain = (bad - good).where(good <= lost, -1.0)
    at = int(gain.to_numpy().argmax())
    return float(counts["bin"].iloc[at]) / BINS if gain.iloc[at] > 0 else 2.0


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, and the anomaly score."""
    statistics = with_statistics(docs)
    scored = with_anomaly(statistics, fit_forest(statistics))
    threshold = calibrated_threshold(scored, labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.select("doc_id", *COUNTS, failed.alias("base_failed"),
                         (~failed & (F.col("anomaly") < threshold)).alias("kept"), "anomaly")
