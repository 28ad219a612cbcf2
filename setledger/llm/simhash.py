"""SimHash near-dedup by covering locality-sensitive hashing.

Each text becomes a 64-bit fingerprint: a bit is set if more than half of its shingles' hashes set it.
Equal fingerprints are one node. Nodes within ``RADIUS`` bits are linked, without a miss:

* *Covering masks.* Every bit position gets a code of ``RADIUS + 1`` bits; the mask of a non-zero vector v keeps
  the positions whose code has an odd product with v. ``RADIUS`` positions span at most ``RADIUS`` dimensions, so
  some v is orthogonal to the codes of all bits in which a pair differs, and the pair agrees under that mask. The
  31 masks of 32 to 34 bits are the tables; nodes that agree under a mask share a bucket.
* *Stars first.* Every node of a bucket is compared with the bucket's smallest and largest node, which is a column
  expression. What is linked so far is contracted, and buckets whose nodes all have one root are done.
* *Open buckets.* Buckets that hold several roots are compared across roots inside a task, and only links come out.
  A bucket of more than ``TASK_NODES`` nodes is first dealt out by covering masks of its free positions: two masks
  together leave 16 free bits at most, so such a bucket never holds more than 65,536 nodes, however large the input.

Rows of the linking steps are a few longs; texts are read once and never shuffled.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer words than a
shingle form one shingle; repeated rows share a node; a null doc_id is never the smallest, and a component with
nothing but null ids has a null component_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from setledger.llm.common import slices
from setledger.session import pin

SHINGLE_WORDS = 4
SEED = 42
BITS = 64
RADIUS = 4

#: Nodes of a bucket that one task compares; a larger bucket is dealt out by second masks.
TASK_NODES = 65_536

_CHUNK = 65_536
_NEAR_ROWS = 64


def covering_masks(positions: Sequence[int], radius: int = RADIUS) -> list[int]:
    """Masks over the positions, one of which is zero at any ``radius`` of them."""
    vectors = 2 ** (radius + 1) - 1
    codes = [(p, 1 + at % vectors) for at, p in enumerate(positions)]
    return [sum(1 << p for p, code in codes if (code & v).bit_count() % 2) for v in range(1, vectors + 1)]


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


MASKS = covering_masks(range(BITS))
#: For each mask, the masks of the positions it leaves free.
INNER_MASKS = [covering_masks([p for p in range(BITS) if not mask >> p & 1]) for mask in MASKS]


def fingerprint(text: str | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The fingerprint as a signed 64-bit number."""
    # bytes know the letters A-Z and the six ASCII blanks only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    size = min(width, len(words))
    begin, end = (ends - lengths)[:len(words) - size + 1], ends[size - 1:]
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(begin), _CHUNK):
        spans = zip(begin[at:at + _CHUNK].tolist(), end[at:at + _CHUNK].tolist())
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.dtype("<u8"), min(_CHUNK, len(begin) - at))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begin), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp of every document, stored."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pd.DataFrame({"doc_id": part["doc_id"], "fp": [fingerprint(t, width) for t in part["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ids travel as text: pandas would turn a column of numbers with nulls into floats
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(work, "doc_id string, fp long")
    return pin(rows.select(F.col("doc_id").cast(kind), "fp"))


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b).

    In each round a node points to the smallest of itself and its neighbours and the graph is contracted along
    the pointers. "Smallest" follows numbers flipped by a new random pattern each round, so that no chain of rising
    numbers can slow it down: about half of the nodes go in a round."""
    rng = random.Random(len(MASKS))
    edges = pin(links.select("a", "b").filter("a != b").distinct())
    levels = []
    while not edges.isEmpty():
        flip = F.lit(_signed(rng.getrandbits(64)))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min(F.col("b").bitwiseXOR(flip)).alias("low"))
        level = pin(low.select("node", F.least("low", F.col("node").bitwiseXOR(flip)).bitwiseXOR(flip).alias("root")))
        levels.append(level)
        ends = [level.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab"]
        edges = pin(edges.join(ends[0], "a").join(ends[1], "b").filter("ra != rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0]
    for level in levels[1:]:
        out = follow(out, level)
    return pin(out)


def follow(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """``placed`` with each root replaced by its own root in ``roots``; one that is not there stays."""
    upper = roots.select(F.col("node").alias("root"), F.col("root").alias("_upper"))
    return placed.join(upper, "root", "left").withColumn("root", F.coalesce("_upper", "root")).drop("_upper")


def within(a: Column, b: Column, radius: int = RADIUS) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def buckets(nodes: DataFrame) -> DataFrame:
    """(t, key, fp): each node's key in each table."""
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in MASKS])
    return nodes.select(F.posexplode(keys).alias("t", "key"), "fp")


def inner_buckets(rows: DataFrame) -> DataFrame:
    """(t, u, key, fp, root): rows of large buckets dealt out by their table's inner masks."""
    inner = F.array(*[F.array(*[F.lit(_signed(m)) for m in masks]) for masks in INNER_MASKS])
    dealt = rows.select("t", "key", "fp", "root", F.posexplode(F.element_at(inner, F.col("t") + 1)).alias("u", "mask"))
    return dealt.select("t", "u", F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "root")


def open_buckets(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of buckets that hold several roots, with the bucket's size."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    return rows.join(sizes.filter("low != high").select(*by, "size").hint("merge"), by)


def _near_links(run: np.ndarray, fp: np.ndarray, root: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Linked root pairs of rows sorted by run; runs of up to ``_NEAR_ROWS`` rows by offset, all runs at once."""
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    sizes = np.diff(starts, append=len(run))
    small = np.repeat(sizes <= _NEAR_ROWS, sizes)
    r, f, g = run[small], fp[small], root[small]
    for step in range(1, int(sizes[sizes <= _NEAR_ROWS].max(initial=0))):
        hit = (r[step:] == r[:-step]) & (g[step:] != g[:-step])
        hit &= np.bitwise_count(f[step:] ^ f[:-step]) <= radius
        yield np.stack([g[:-step][hit], g[step:][hit]], axis=1)
    for start, size in zip(starts[sizes > _NEAR_ROWS], sizes[sizes > _NEAR_ROWS]):
        f, g = fp[start:start + size], root[start:start + size]
        names, members = np.unique(g, return_counts=True)
        # what lies outside the largest root meets everything; inside that root nothing is left to find
        others = np.flatnonzero(g != names[members.argmax()])
        step = max(1, 2**20 // size)
        for at in range(0, len(others), step):
            mine = others[at:at + step]
            near = np.bitwise_count(f[mine, None] ^ f[None, :]) <= radius
            i, j = np.nonzero(near & (g[mine, None] != g[None, :]))
            yield np.unique(np.stack([g[mine[i]], g[j]], axis=1), axis=0)


def links_across(rows: DataFrame, by: list[str], radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the roots of each bucket. A bucket is a run of sorted rows in one task; the caller
    bounds its size."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def linked(part: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
            pairs = list(_near_links(run, part["fp"].to_numpy().view(np.uint64), part["root"].to_numpy(), radius))
            found = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0) if pairs else np.zeros((0, 2), np.int64)
            return pd.DataFrame(found, columns=["a", "b"])

        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = rows[by].to_numpy(np.int64)
            run = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))])[:len(keys)]
            last = int(np.searchsorted(run, run[-1])) if len(run) else 0  # the last run may go on
            if last:
                yield linked(rows.iloc[:last], run[:last])
            held = rows.iloc[last:]
        if held is not None and len(held):
            yield linked(held, np.zeros(len(held), np.int64))

    dealt = rows.select(*by, "fp", "root").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInPandas(work, "a long, b long").distinct()


def node_roots(nodes: DataFrame, radius: int = RADIUS, task_nodes: int = TASK_NODES) -> DataFrame:
    """(node, root) of the fingerprints that have a neighbour within the radius."""
    keyed = buckets(nodes)
    hubs = keyed.groupBy("t", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low != high")
    shared = pin(keyed.join(hubs.hint("merge"), ["t", "key"]))
    stars = [shared.filter(within(F.col("fp"), F.col(hub), radius)).select(F.col("fp").alias("a"), F.col(hub).alias("b"))
             for hub in ("low", "high")]
    roots = connected(stars[0].union(stars[1]))
    placed = follow(shared.select("t", "key", "fp", F.col("fp").alias("root")), roots)
    left = pin(open_buckets(placed, ["t", "key"]))
    links = links_across(left.filter(F.col("size") <= task_nodes), ["t", "key"], radius)
    large = pin(left.filter(F.col("size") > task_nodes))
    if not large.isEmpty():
        by = ["t", "u", "key"]
        links = links.union(links_across(open_buckets(inner_buckets(large), by), by, radius))
    upper = connected(links)
    ends = follow(roots, upper)
    # a node without a star link can be a root of the second round
    return pin(ends.union(upper.join(roots.select("node"), "node", "left_anti").select("node", "root").select(*ends.columns)))


def simhash_components(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS,
                       task_nodes: int = TASK_NODES) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id reachable) of every document."""
    printed = fingerprints(docs, width)
    nodes = pin(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    placed = follow(nodes.select("first_id", F.col("fp").alias("node"), F.col("fp").alias("root")),
                    node_roots(nodes.select("fp"), radius, task_nodes))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(smallest.hint("merge"), "root").select(F.col("node").alias("fp"), "component_id")
    return printed.join(named.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
