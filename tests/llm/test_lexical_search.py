"""Best-first search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from setledger.llm import lexical_search as lexical
from setledger.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n, total = len(counted), sum(size for _, _, size in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for i, c, size in counted:
            m = 100 - 25 + (25 * size * n) // total
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, k in asked.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:20])]
    return sorted(out, key=repr)


def check(docs, items, **settings):
    got = sorted(map(tuple, lexical.search(docs, items, **settings).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_whole_table(spark):
    check(table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark"))


def test_many_shards_and_query_blocks(rows):
    rng = random.Random(2)
    words = [f"t{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(600)]
    docs += [(1_000 + k, "t1 t2 t3 same text") for k in range(300)]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for k in range(25)] + [(90, "same same text")]
    made = rows("doc_id long, text string", *docs), rows("item_id long, text string", *items)
    check(*made)
    check(*made, shard_postings=500, chars=200)


def test_ranges_of_the_sparse_tables():
    rng = random.Random(4)
    docs = pd.DataFrame([(str(k), 50, sorted(rng.sample(range(6), 3)), [rng.randint(1, 4) for _ in range(3)]) for k in range(200)],
                        columns=["doc_id", "n", "terms", "counts"])
    shard = lexical.Shard(docs, np.array([0, 5, 700, 900, 20, 3]), 200, 10_000)
    spans = [sorted(rng.sample(range(shard.start[t], shard.start[t + 1]), 2)) for t in range(6) for _ in range(200)]
    low, high = np.array(spans).T
    for a, b, at in zip(low, high, shard.peak(low, high)):
        assert at == a + shard.impact[a:b].argmax()


def test_odd_rows(rows, spark):
    docs = rows("doc_id long, text string, n long, terms string, q long, rank string",
                (1, None, 1, "k", 1, "k"), (2, "", 1, "k", 1, "k"), (3, " .,", 1, "k", 1, "k"), (None, "alpha beta", 1, "k", 1, "k"),
                (4, "Alpha BETA", 1, "k", 1, "k"), (4, "Alpha BETA", 1, "k", 1, "k"), (2**60 + 1, "alpha", 1, "k", 1, "k"),
                (6, "filler words " * 200_000, 1, "k", 1, "k"), (7, "É beta_gamma", 1, "k", 1, "k"))
    items = rows("item_id string, text string, doc_id long, score long",
                 ("a", "alpha, beta", 1, 1), ("a", "alpha, beta", 1, 1), (None, "FILLER É", 1, 1), ("e", "", 1, 1), ("n", None, 1, 1),
                 ("x", "absent", 1, 1))
    check(docs, items)
    none = spark.createDataFrame([], docs.schema)
    assert lexical.search(none, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
