"""Weights, draws and ranks against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from setledger.llm import resample
from setledger.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def brute(docs, target):
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in s}
    rows = []
    for i, words, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(able[:5 * len(able) // 100])}
    return sorted((tuple(r[:4]) + (drawn.get(id(r)),) for r in rows), key=repr)


def check(docs, target, **settings):
    got = resample.resample(docs, target, **settings).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert sorted(map(tuple, got), key=repr) == want


def test_whole_table(spark):
    check(table(spark, FOLDER, "documents"), table(spark, FOLDER, "benchmark"))


def test_buckets_of_runs():
    texts = ["One two, THREE four", None, "", "é" * 200 + " b " + "x" * 300 + " c d e", "a", "." * 9, "9 " * 40]
    counts, owner, runs = resample.feature_buckets(texts)
    for k, text in enumerate(texts):
        words, want = features(text)
        assert counts[k] == words
        assert Counter(want) == Counter(int(b) for run in runs for b in run[owner == k] if b >= 0)


def test_radix_order_with_ties_and_negative_numbers(spark):
    rng = random.Random(8)
    made = [(rng.choice([None, -2**63, 2**63 - 1, rng.randint(-3, 3), rng.randint(-2**40, 2**40)]), rng.randint(0, 200_000),
             0, rng.choice([0, -5, 10**9, -10**9, rng.randint(-10**7, 10**7)])) for _ in range(3_000)]
    rows = spark.createDataFrame(made, "doc_id long, n_features long, weight long, score long").repartition(5)
    got = [tuple(r)[:4] for r in resample.radix_sorted(rows, block=97).orderBy("pos").collect()]
    assert got == sorted(made, key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    places = resample.radix_sorted(rows, block=97).agg(F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()
    assert tuple(places) == (0, 2_999, 3_000)


def test_odd_rows(rows, spark):
    body = " ".join(f"w{k}" for k in range(30))
    docs = rows("doc_id long, text string, score string, rank long, pos int",
                (1, None, "k", 1, 1), (2, "", "k", 1, 1), (3, " .. ", "k", 1, 1), (None, body, "k", 1, 1), (7, body, "k", 1, 1),
                (7, body, "k", 1, 1), (7, body + " w1", "k", 1, 1), (2**60 + 1, "long words " * 60_000, "k", 1, 1),
                *[(100 + k, body + f" {k}", "k", 1, 1) for k in range(40)])
    target = rows("item_id long, text string, n long", (1, "w1 w2 w3", 1), (1, None, 1))
    check(docs, target, block=7)
    check(docs, target.limit(0))
    none = spark.createDataFrame([], docs.schema)
    assert resample.resample(none, target).count() == 0
