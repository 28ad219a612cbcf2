"""From candidate buckets to groups, without the pairs inside a group.

``link_groups`` takes (key, node) rows, where nodes that may be linked share a key, and a function that
keeps the truly linked of given pairs. It returns the links of a graph whose connected components are
those of the full link graph:

1. every node meets the hub (the best connected node) of one of its buckets;
2. nodes still apart from the hubs of their other buckets meet those;
3. in buckets that still hold nodes of several components, nodes are packed into blocks of bounded size
   and each pair of blocks is compared inside a task, across components only; only links come out, so no
   row is made for a pair that is not linked. Every candidate pair is then either checked or inside one
   component.

A group of n near copies so costs about n checks in step 1. Sizes and hubs come from sums
per key (combined on the map side); all else are joins that Spark may split when a key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from setledger.session import pin

#: Nodes of a key that are compared within one task.
BLOCK = 128

Compare = Callable[[int, list, list], Iterable[tuple[int, int]]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); nodes of one component have one root.

    Every node points to the smallest node next to it, and the graph is contracted along the pointers
    until no link is left; path lengths shrink at least by half a round."""
    edges = pin(links.select("a", "b").filter("a != b").distinct())
    levels = []
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        level = pin(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
            "node", F.least("node", "low").alias("root")))
        levels.append(level)
        left = level.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = level.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = pin(edges.join(left, "a").join(right, "b").filter("ra != rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0]
    for level in levels[1:]:
        upper = level.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(upper, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return pin(out)


def with_root(rows: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """The root of ``column``; a node without links is its own."""
    known = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return rows.join(known, column, "left").withColumn(name, F.coalesce("_root", column)).drop("_root")


def shared_buckets(buckets: DataFrame) -> DataFrame:
    """(key, node, hub) of the keys that hold two nodes or more, stored. A key's hub is the node that
    meets most others over all its keys: the middle of a group, to which its members are closest."""
    sizes = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"),
                                       F.count("*").alias("size")).filter("low != high")
    shared = pin(buckets.join(sizes.select("key", "size"), "key").distinct())
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))
    ranked = shared.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("best"))
    return pin(shared.select("key", "node").join(ranked.select("key", F.col("best.node").alias("hub")), "key"))


def links_across(rows: DataFrame, payload: DataFrame, compare: Compare, block: int = BLOCK) -> DataFrame:
    """Links between nodes of one key and of different roots, from (key, node, root) rows.

    A key's nodes are dealt into blocks of about ``block`` nodes by hash, and every pair of its blocks is
    one row. ``payload`` has a node and what ``compare(key, left, right)`` needs of it; that function gets
    lists of payload structs (with node and root) and yields the index pairs that are linked."""
    columns = [c for c in payload.columns if c != "node"]
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    packed = pin(dealt.join(payload, "node").groupBy("key", "block").agg(
        F.collect_list(F.struct("node", "root", *columns)).alias("nodes")))
    right = packed.select("key", F.col("block").alias("other"), F.col("nodes").alias("others"))
    met = packed.join(right, "key").filter("block <= other").select(
        "key", (F.col("block") == F.col("other")).alias("same"), "nodes",
        F.when(F.col("block") != F.col("other"), F.col("others")).alias("others"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for key, same, left, right in zip(batch["key"], batch["same"], batch["nodes"], batch["others"]):
                other = left if same else right
                found += [(left[i]["node"], other[j]["node"]) for i, j in compare(key, left, other)
                          if left[i]["root"] != other[j]["root"]]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.mapInPandas(work, "a long, b long").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def link_groups(shared: DataFrame, verify: Callable[[DataFrame], DataFrame], payload: DataFrame, compare: Compare) -> DataFrame:
    """(node, root) from ``shared_buckets``; ``verify`` maps pairs (a, b), a < b, to the linked ones;
    ``payload`` and ``compare`` serve ``links_across``."""
    low, high = F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    stars = pin(shared.filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("keys")))
    first = pin(stars.groupBy("node").agg(F.max_by("hub", F.struct("keys", "hub")).alias("hub")).select(low, high).distinct())
    tested = pin(stars.select(low, high).distinct())
    links = pin(verify(first))
    roots = components(links)
    rest = with_root(with_root(tested.join(first, ["a", "b"], "left_anti"), "a", roots, "ra"), "b", roots, "rb")
    links = pin(links.unionByName(verify(pin(rest.filter("ra != rb").select("a", "b")))))
    roots = components(links)
    placed = with_root(shared.select("key", "node"), "node", roots, "root")
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    open_rows = pin(placed.join(split.select("key"), "key", "left_semi").distinct())
    last = pin(links_across(open_rows, payload, compare))
    return roots if last.isEmpty() else components(links.unionByName(last))
