"""Fingerprints and their groups against brute force over all pairs."""

import random

import numpy as np
import xxhash

from setledger.llm import simhash
from setledger.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in low).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 4]).encode(), seed=42) for k in range(max(1, len(words) - 3))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_roots(prints, radius=4):
    """Each fingerprint's component by flood fill over all pairs."""
    prints = np.array(sorted(set(prints)), np.uint64)
    name = np.full(len(prints), -1)
    for start in range(len(prints)):
        queue = [start] if name[start] < 0 else []
        name[queue] = start
        while queue:
            near = np.flatnonzero((np.bitwise_count(prints ^ prints[queue.pop()]) <= radius) & (name < 0))
            name[near] = start
            queue.extend(near)
    return dict(zip(prints.tolist(), name.tolist()))


def check(docs, **settings):
    rows = simhash.simhash_components(docs, **settings).collect()
    texts = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    roots = brute_roots([p for _, p in texts])
    smallest = {}
    for i, p in texts:
        smallest[roots[p]] = min(i, smallest.get(roots[p], i))
    assert sorted(map(tuple, rows)) == sorted((i, f"{p:016x}", smallest[roots[p]]) for i, p in texts)


def test_masks_cover_every_set_of_positions():
    rng = random.Random(3)
    for _ in range(5_000):
        bits = sum(1 << p for p in rng.sample(range(64), 4))
        at = [k for k, m in enumerate(simhash.MASKS) if not m & bits]
        assert at
        for k in at:  # the inner masks cover the same pairs, and leave at most 16 positions free
            assert any(not m & bits for m in simhash.INNER_MASKS[k])
    assert all((a | b).bit_count() >= 48 for a, inner in zip(simhash.MASKS, simhash.INNER_MASKS) for b in inner)


def test_whole_table(spark):
    check(table(spark, FOLDER, "documents"))


def groups(rng):
    """Groups whose members drift apart step by step, dense clouds, and strays next to them."""
    out = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(60):
            at ^= sum(1 << p for p in rng.sample(range(64), rng.randint(1, 7)))
            out.append(at)
    centre = rng.getrandbits(64)
    out += [centre ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 9))) for _ in range(2_500)]
    few = rng.getrandbits(64)
    out += [few ^ sum(1 << p for p in rng.sample(range(9), rng.randint(0, 9))) for _ in range(300)]
    return out


def test_links_without_a_miss(spark):
    prints = groups(random.Random(11))
    nodes = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in set(prints)], "fp long")
    want = brute_roots(prints)
    for task_nodes in (65_536, 40):  # the second bound deals most buckets out by inner masks
        found = {r.node % 2**64: r.root for r in simhash.node_roots(nodes, task_nodes=task_nodes).collect()}
        got = {p: found.get(p, p - 2**64 if p >= 2**63 else p) for p in want}
        pairs = {(got[p], want[p]) for p in want}
        assert len(pairs) == len(set(got.values())) == len(set(want.values()))


def test_long_chain_of_rising_numbers(spark):
    links = spark.range(3_000).selectExpr("id as a", "id + 1 as b")
    assert simhash.connected(links).select("root").distinct().count() == 1


def test_odd_rows(rows, spark):
    long = "word " * 300_000
    docs = rows("doc_id long, text string, fp long, root long, node string, t int",
                (5, None, 1, 1, "k", 1), (4, "", 1, 2, "k", 1), (6, " \n\t", 1, 2, None, 1), (1, "Two words", 0, 0, "k", 1),
                (2, "two\nWORDS", 0, 0, "k", 1), (2, "two\nWORDS", 0, 0, "k", 1), (None, "two words", 0, 0, "k", 1),
                (None, "alone here", 0, 0, "k", 1), (9, long, 0, 0, "k", 1), (8, long, 0, 0, "k", 1), (3, "É é a b c d", 0, 0, "k", 1))
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()), key=repr)
    assert [(i, c) for i, f, c in got if f == "0" * 16] == [(4, 4), (5, 4), (6, 4)]
    two = f"{brute_fingerprint('two words'):016x}"
    assert [(i, c) for i, f, c in got if f == two] == [(1, 1), (2, 1), (2, 1), (None, 1)]
    alone = f"{brute_fingerprint('alone here'):016x}"
    assert (None, alone, None) in got and len(got) == 11
    assert {c for i, f, c in got if i in (8, 9)} == {8}
    assert simhash.simhash_components(spark.createDataFrame([], docs.schema)).count() == 0
