"""MinHash near-dedup with sequential Bayesian verification.

A document is the set of its distinct word shingles. Equal sets form one class, and only one member of a
class goes on. Classes are hashed into signatures (one byte per hash function), banded into candidate
buckets, and linked by ``linkage.link_groups``: a candidate pair's signatures are compared batch by
batch; after each batch the pair is dropped if the posterior chance (flat prior) that its similarity
reaches the threshold is below ``MISS``; what is left after the last batch is verified on the full sets.

40 bands of 6 rows let a pair of similarity 0.8 slip with a chance below 6e-6; the sequential test adds
about ``MISS``. Text travels only for documents that share a bucket.

Defined results: a null or blank text has an empty set, its own component and no links; fewer words than
a shingle form one shingle; repeated rows and equal texts are one class; of rows with one doc_id each
keeps its own set, and all of them are kept if that id is the smallest of the component; a null doc_id
never is the smallest and its row is kept only when its component has no other id; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from setledger.llm.common import blank_word_hashes, mixed, slices
from setledger.llm.linkage import link_groups, shared_buckets
from setledger.session import pin

SHINGLE_WORDS = 4
PERCENT = 80
BANDS = 40
ROWS = 6
HASHES = BANDS * ROWS
BATCH = 48
MISS = 1e-7
_CHUNK = 1_024

#: A row by its id and text.
TEXT_KEY = "xxhash64(doc_id, text)"


def shingle_sets(texts: list[str | None], width: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles."""
    words, starts = blank_word_hashes(texts)
    rolled = words[:max(0, len(words) - width + 1)].copy()
    for at in range(1, width):
        rolled *= np.uint64(0xD6E8FEB86659FD93)
        rolled += words[at:len(words) - width + 1 + at]
    rolled = mixed(rolled)
    out = []
    for start, end in zip(starts[:-1], starts[1:]):
        if end - start >= width:
            out.append(np.unique(rolled[start:end - width + 1]))
        else:  # all words as one shingle, apart from shingles of full width
            whole = np.uint64(end - start)
            for word in words[start:end]:
                whole = mixed(np.array([whole ^ word], np.uint64) * np.uint64(0xA0761D6478BD642F))[0]
            out.append(np.array([whole] if end > start else [], np.uint64))
    return out


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, HASHES, np.uint32)


def signature(found: np.ndarray) -> np.ndarray:
    """One number per band: a byte for each of its hash functions, taken from the function's smallest
    value over the set, and the band's number on top. Empty for the empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    factor, flip = _functions()
    short = (found >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 2**32 - 1, np.uint32)
    for start in range(0, len(short), _CHUNK):
        values = short[start:start + _CHUNK, None] * factor
        values ^= flip
        np.minimum(low, values.min(axis=0), out=low)
    out = np.zeros((BANDS, 8), np.uint8)
    out[:, :ROWS] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).reshape(BANDS, ROWS)
    out[:, ROWS] = np.arange(BANDS)
    return out.view(np.int64).ravel()


def sketches(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_key, n_shingles, set digest (hi, lo) and signature of every document, stored."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                rows = []
                for found in shingle_sets(part["text"].tolist(), width):
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    rows.append((len(found), *np.frombuffer(digest, np.int64).tolist(), signature(found)))
                out = pd.DataFrame(rows, columns=["n_shingles", "hi", "lo", "sig"])
                yield pd.concat([part[["doc_id", "text_key"]].reset_index(drop=True), out], axis=1)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pin(docs.select("doc_id", F.expr(TEXT_KEY).alias("text_key"), "text").mapInPandas(
        work, f"doc_id {kind}, text_key long, n_shingles long, hi long, lo long, sig array<long>"))


def classes(sketched: DataFrame) -> DataFrame:
    """One stored row per distinct non-empty set: node, hi, lo, its smallest doc_id, the key of a row that
    has it, and its signature.
    Copies are combined before the shuffle."""
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    rows = sketched.filter("n_shingles > 0").groupBy("hi", "lo").agg(
        F.min("doc_id").alias("doc_id"), F.min_by("text_key", last).alias("text_key"), F.first("sig").alias("sig"))
    return pin(rows.select(F.monotonically_increasing_id().alias("node"), "*"))


def bands(nodes: DataFrame) -> DataFrame:
    """(key, node): the signature's numbers are the keys."""
    return nodes.select(F.explode("sig").alias("key"), "node")


@lru_cache(maxsize=8)
def least_agreements(percent: int = PERCENT, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(hashes compared, agreements below which a pair is dropped) after each batch: the smallest count
    whose posterior chance of reaching the threshold is ``miss`` or more. Bytes agree by accident once
    in 256."""
    similarity = np.linspace(0.0, 1.0, 20_001)
    agree = similarity + (1 - similarity) / 256
    above = similarity >= percent / 100
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        least = 0
        for m in range(n + 1):
            with np.errstate(divide="ignore"):
                log = m * np.log(agree) + (n - m) * np.log(np.maximum(1 - agree, 1e-300))
            weight = np.exp(log - log.max())
            if weight[above].sum() / weight.sum() >= miss:
                least = m
                break
        out.append((n, least))
    return tuple(out)


def survivors(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that no batch of their signatures rules out."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            left, right = (np.stack(batch[c].to_list()).view(np.uint8).reshape(-1, BANDS, 8)[:, :, :ROWS].reshape(-1, HASHES)
                           for c in ("sa", "sb"))
            alive, count, done = np.arange(len(batch)), np.zeros(len(batch), np.int64), 0
            for upto, least in least_agreements(percent):
                count[alive] += (left[alive, done:upto] == right[alive, done:upto]).sum(axis=1)
                alive, done = alive[count[alive] >= least], upto
            yield batch.iloc[alive][["a", "b"]]

    signed = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(
        nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return signed.select("a", "b", "sa", "sb").mapInPandas(work, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Do two sets reach the threshold?"""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def exact_links(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked, known = [], {}
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                told = {**dict(zip(part["a"], part["ta"])), **dict(zip(part["b"], part["tb"]))}
                known = {n: known[n] for n in told if n in known}
                new = [n for n in told if n not in known]
                known.update(zip(new, shingle_sets([told[n] for n in new], width)))
                linked += [similar(known[a], known[b], percent) for a, b in zip(part["a"], part["b"])]
            yield batch.loc[linked, ["a", "b"]]

    told = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return told.select("a", "b", "ta", "tb").mapInPandas(work, "a long, b long")


def compare_blocks(percent: int = PERCENT, width: int = SHINGLE_WORDS):
    """For ``linkage.links_across``: pairs whose first common band is this key's, then batch by batch, then
    on the full sets."""
    def compare(key: int, left: list[dict], right: list[dict]) -> Iterator[tuple[int, int]]:
        a, b = (np.stack([np.asarray(n["sig"], np.int64) for n in side]) for side in (left, right))
        band = key >> 8 * ROWS
        meet = a[:, None, band] == b[None, :, band]
        for earlier in range(band):
            meet &= a[:, None, earlier] != b[None, :, earlier]
        meet &= np.array([n["root"] for n in left])[:, None] != np.array([n["root"] for n in right])[None, :]
        if left is right:
            meet = np.triu(meet, 1)
        i, j = np.nonzero(meet)
        if not len(i):
            return
        x, y = (side.view(np.uint8).reshape(-1, BANDS, 8)[:, :, :ROWS].reshape(-1, HASHES) for side in (a, b))
        count, done = np.zeros(len(i), np.int64), 0
        for upto, least in least_agreements(percent):
            count += (x[i, done:upto] == y[j, done:upto]).sum(axis=1)
            i, j, count, done = i[count >= least], j[count >= least], count[count >= least], upto
        need_left, need_right = np.unique(i), np.unique(j)
        sets_left = dict(zip(need_left, shingle_sets([left[k]["text"] for k in need_left], width)))
        sets_right = dict(zip(need_right, shingle_sets([right[k]["text"] for k in need_right], width)))
        for k, m in zip(i, j):
            if similar(sets_left[k], sets_right[m], percent):
                yield int(k), int(m)

    return compare


def class_texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, stored. Text is shuffled once, by the key of id and text; rows
    that repeat both are dropped where they meet."""
    needed = nodes.select("node", "text_key").join(wanted, "node", "left_semi")
    met = docs.select(F.expr(TEXT_KEY).alias("text_key"), "text").join(needed, "text_key")
    return pin(met.dropDuplicates(["text_key"]).select("node", "text"))


def set_components(docs: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The stored sketches, and for each distinct set (hi, lo): component_id and the key of the row that
    stands for the component."""
    sketched = sketches(docs, width)
    nodes = classes(sketched)
    shared = shared_buckets(bands(nodes))
    texts = class_texts(docs, nodes, shared.select("node").distinct())
    roots = link_groups(shared, lambda pairs: exact_links(pin(survivors(pairs, nodes, percent)), texts, percent, width),
                        nodes.select("node", "sig").join(texts, "node"), compare_blocks(percent, width))
    grouped = nodes.select("node", "hi", "lo", "doc_id", "text_key").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    last = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "text_key")
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min_by("text_key", last).alias("stays"))
    return sketched, pin(grouped.join(smallest, "root").select("hi", "lo", "component_id", "stays"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    sketched, named = set_components(docs, percent, width)
    # only the empty set has no class
    out = sketched.select("doc_id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id. Rows without words all
    stay. Of rows that repeat id and text, one stays. Only ids of removed rows meet the texts."""
    sketched, named = set_components(docs, percent, width)
    gone = sketched.filter("n_shingles > 0").join(named, ["hi", "lo"]).filter("text_key != stays").select(
        F.col("text_key").alias("_key")).distinct()
    once = sketched.filter("n_shingles > 0").groupBy("text_key").count().filter("count > 1").select(
        F.col("text_key").alias("_key")).join(gone, "_key", "left_anti")
    left = docs.withColumn("_key", F.expr(TEXT_KEY)).join(gone, "_key", "left_anti")
    if once.isEmpty():
        return left.select(*docs.columns)
    repeated = left.join(once, "_key", "left_semi").dropDuplicates(["_key"])
    return left.join(once, "_key", "left_anti").unionByName(repeated).select(*docs.columns)
