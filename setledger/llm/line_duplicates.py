"""Line dedup by a segment-partition edit join.

Lines (split at newlines, blanks at the ends ignored) of ``MIN_CHARS`` characters and more are compared
across all documents. Exact copies are one class. Two classes are linked if their edit distance is at
most the budget of the shorter line: 0 below 32 characters, 1 below 96, 2 from there on.

A line within t edits of another, cut into t + 1 even segments, leaves one segment untouched. So every
line puts its segments into an index by (length, segment number, content), and looks up, for each length
from its own down to t less, the substrings that can align with a segment: those whose shift is possible
both from the left and from the right. Lines that meet are verified with a bit-parallel automaton over
the diagonals within t of the main one. Groups are found by ``linkage.link_groups``; a group of n near
copies costs about n checks.

The first occurrence of a group, by (doc_id, hash of the text, line number) with null ids last, stays;
all other occurrences are dropped.

Defined results: a null text has no line; blank and shorter lines always stay; rows with equal doc_id and
text count as one document and lose the same lines; a document whose lines with words are all dropped
leaves the corpus, one that was blank before stays; an empty table gives an empty result; other columns
stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from setledger.llm.common import SpanHashes, code_points, mixed, slices
from setledger.llm.linkage import link_groups, shared_buckets
from setledger.session import pin

MIN_CHARS = 16
#: Shortest line for each edit budget from 1 on.
BUDGET_FROM = (32, 96)
BLANKS = " \t\r\x0b\x0c"
FILTER_BITS = 1 << 26


def budget(length):
    """Edits allowed for a shorter line of this length."""
    return sum((np.asarray(length) >= least).astype(np.int64) for least in BUDGET_FROM)


def line_occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no and digest (node, check) of the compared lines of all documents, stored: texts are
    split and lines hashed once."""
    cut = docs.select("doc_id", F.expr("xxhash64(doc_id, text)").alias("text_key"),
                      F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    lines = cut.select("doc_id", "text_key", "line_no", F.btrim("raw", F.lit(BLANKS)).alias("line")).filter(
        F.length("line") >= MIN_CHARS)
    return pin(lines.select("doc_id", "text_key", "line_no", F.xxhash64("line").alias("node"),
                            F.xxhash64(F.lit(1), "line").alias("check")))


def compared_lines(texts: list[str | None], least: int = MIN_CHARS) -> list[str]:
    return [line for text in texts if text for raw in text.split("\n") if len(line := raw.strip(BLANKS)) >= least]


def line_nodes(lines: list[str]) -> np.ndarray:
    """The number that ``xxhash64`` gives each line."""
    return np.fromiter((xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42) for line in lines),
                       np.uint64, len(lines)).view(np.int64)


def _first():
    """The order of occurrences."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "line_no")


def line_counts(occurrences: DataFrame) -> DataFrame:
    """node, check and number of occurrences of each distinct line. No text is shuffled."""
    return occurrences.groupBy("node", "check").agg(F.count("*").alias("times"))


def segment_bounds(length: np.ndarray, edits: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``number`` (from 0) of ``edits + 1`` even ones; the last are longer."""
    base, longer = length // (edits + 1), length % (edits + 1)
    first_longer = edits + 1 - longer
    return number * base + np.maximum(0, number - first_longer), base + (number >= first_longer)


def segment_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the line) of all segments and all substrings looked up. Equal keys: same indexed
    length, same segment number, same content."""
    points, starts = code_points(lines)
    hashes = SpanHashes(points)
    starts, length = starts[:-1], np.diff(starts)
    keys, owners = [], []
    for edits in range(1, len(BUDGET_FROM) + 1):
        for less in range(edits + 1):
            mine = np.flatnonzero(budget(length - less) == edits)
            short = length[mine] - less
            for number in range(edits + 1):
                at, size = segment_bounds(short, edits, number)
                left, right = number, edits - number
                for shift in range(max(-left, less - right), min(left, less + right) + 1):
                    begin = at + shift
                    fits = (begin >= 0) & (begin + size <= length[mine])
                    own = mine[fits]
                    value = hashes.of(starts[own] + begin[fits], size[fits])
                    value ^= (short[fits] * 8 + number).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
                    keys.append(mixed(value).view(np.int64))
                    owners.append(own)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def segment_buckets(docs: DataFrame) -> DataFrame:
    """(key, node) of all lines long enough for an edit, straight from the texts; a line that a task meets
    again in the same stretch of rows is left out there."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                lines = list(dict.fromkeys(compared_lines(part["text"].tolist(), BUDGET_FROM[0])))
                keys, owners = segment_keys(lines)
                yield pd.DataFrame({"key": keys, "node": line_nodes(lines)[owners]})

    return docs.select("text").mapInPandas(work, "key long, node long")


def node_filter(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of one hash over the nodes: its bits, and 64-bit words. At most ``FILTER_BITS`` bits
    whatever the number of nodes; if it fills up it only lets more lines pass to the join behind it."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * nodes.count()).bit_length()))
    at = F.pmod(F.col("node"), F.lit(bits))
    words = nodes.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(node, 64) as int))")).alias("mask")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return bits, out


def wanted_lines(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, line) of the given nodes, stored. A bounded filter keeps other lines from the shuffle."""
    bits, words = node_filter(nodes)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                lines = list(dict.fromkeys(compared_lines(part["text"].tolist(), BUDGET_FROM[0])))
                own = line_nodes(lines)
                at = own % bits
                passed = (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                yield pd.DataFrame({"node": own[passed], "line": np.array(lines, object)[passed]})

    found = docs.select("text").mapInPandas(work, "node long, line string")
    return pin(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def within(a: str, b: str, edits: int) -> bool:
    """Is the edit distance at most ``edits``?

    Bit i of ``reach[d]`` says that after the text's first j characters the pattern's first
    ``j - edits + i`` are matched with d edits at most. Equal ends are cut off first."""
    if abs(len(a) - len(b)) > edits:
        return False
    if a == b:
        return True
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    high -= low
    end = 0
    while end < high and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[low:len(a) - end], b[low:len(b) - end]
    if not edits:
        return not a and not b
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << (i + edits))
    full = (1 << (2 * edits + 1)) - 1
    reach = [((1 << (d + 1)) - 1) << edits & full for d in range(edits + 1)]
    for j, char in enumerate(b):
        same = where.get(char, 0) >> j & full
        above, before = reach[0] & same, reach[0]
        new = [above]
        for d in range(1, edits + 1):
            above = (reach[d] & same | before | before >> 1 | above << 1) & full
            before = reach[d]
            new.append(above)
        reach = new
        if not reach[-1]:
            return False
    return bool(reach[edits] >> (len(a) - len(b) + edits) & 1)


def close_lines(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs of nodes within the budget of their shorter line."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = np.minimum(batch["ta"].str.len().to_numpy(), batch["tb"].str.len().to_numpy()).astype(np.int64)
            allowed = budget(size).tolist() if len(batch) else []
            linked = [within(x, y, k) for x, y, k in zip(batch["ta"], batch["tb"], allowed)]
            yield batch.loc[linked, ["a", "b"]]

    sizes = lines.select("node", "line")
    told = pairs.join(sizes.select(F.col("node").alias("a"), F.col("line").alias("ta")), "a").join(
        sizes.select(F.col("node").alias("b"), F.col("line").alias("tb")), "b")
    return told.filter(F.abs(F.length("ta") - F.length("tb")) <= len(BUDGET_FROM)).select(
        "a", "b", "ta", "tb").mapInPandas(work, "a long, b long")


def char_counts(lines: list[str]) -> np.ndarray:
    """How often each of 32 groups of characters occurs, a row per line."""
    points, starts = code_points(lines)
    owner = np.repeat(np.arange(len(lines)), np.diff(starts))
    return np.bincount(owner * 32 + points % 32, minlength=32 * len(lines)).reshape(-1, 32).astype(np.int32)


def compare_blocks(key: int, left: list[dict], right: list[dict]) -> Iterator[tuple[int, int]]:
    """For ``linkage.links_across``: pairs of lines within the budget of the shorter one. An edit changes
    the character counts by two at most, so counts that differ by more than twice the budget rule a pair
    out before it is aligned."""
    size = [np.array([len(n["line"]) for n in side]) for side in (left, right)]
    root = [np.array([n["root"] for n in side]) for side in (left, right)]
    allowed = budget(np.minimum(size[0][:, None], size[1][None, :]))
    near = (np.abs(size[0][:, None] - size[1][None, :]) <= allowed) & (root[0][:, None] != root[1][None, :])
    if left is right:
        near = np.triu(near, 1)
    counts = [char_counts([n["line"] for n in side]) for side in (left, right)]
    i, j = np.nonzero(near)
    alike = np.abs(counts[0][i] - counts[1][j]).sum(axis=1) <= 2 * allowed[i, j]
    for i, j in zip(i[alike], j[alike]):
        if within(left[i]["line"], right[j]["line"], int(allowed[i, j])):
            yield int(i), int(j)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """text_key, dropped (sorted line numbers, from 0) and class_docs (the documents of the first
    occurrences), for each document that loses lines; stored."""
    occurrences = line_occurrences(docs)
    shared = shared_buckets(segment_buckets(docs))
    texts = wanted_lines(docs, pin(shared.select("node").distinct()))
    roots = link_groups(shared, lambda pairs: close_lines(pairs, texts), texts, compare_blocks)
    # a line that is alone and occurs once keeps its place without a look; a line that is alone is its own root, and
    # the check tells it from another line with the same number
    grouped = line_counts(occurrences).join(roots, "node", "left").filter("root IS NOT NULL OR times > 1").select(
        "node", "check", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("check")).otherwise(0).alias("apart"))
    places = pin(occurrences.join(grouped, ["node", "check"]))
    firsts = places.groupBy("root", "apart").agg(F.min(_first()).alias("stays"))
    lost = places.join(firsts, ["root", "apart"]).filter(~_first().eqNullSafe(F.col("stays")))
    return pin(lost.groupBy("text_key").agg(
        F.array_sort(F.collect_set("line_no")).alias("dropped"),
        F.array_sort(F.collect_set("stays.doc_id")).alias("class_docs")))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts, all columns kept; documents that lose
    all their words leave."""
    lost = dropped_lines(docs).select("text_key", "dropped")
    met = docs.withColumn("_key", F.expr("xxhash64(doc_id, text)")).join(
        lost.withColumnRenamed("text_key", "_key"), "_key", "left")
    rest = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    empty = F.col("dropped").isNotNull() & (F.length(F.btrim("_text", F.lit(BLANKS + "\n"))) == 0)
    changed = met.withColumn("_text", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(rest))
    return changed.filter(~F.coalesce(empty, F.lit(False))).withColumn("text", F.col("_text")).select(*docs.columns)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped_lines and class_docs for every document."""
    counted = docs.select("doc_id", F.expr("xxhash64(doc_id, text)").alias("text_key"),
                          F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n"), "text").select(
        "doc_id", "text_key", F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).cast("long").alias("n_lines"))
    met = counted.join(dropped_lines(docs), "text_key", "left")
    return met.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped_lines"),
                      F.coalesce("class_docs", F.array().cast("array<bigint>")).alias("class_docs"))
