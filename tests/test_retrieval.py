import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from setledger.operators import retrieval as R, vectorize as Z


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(300, 8))
    v[100:200] = v[0]  # a third of the rows are copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    qs = np.vstack([v[0], rng.normal(size=(30, 8))])
    vectors = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "chunk_key bigint, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(x) for x in row], f"what is squat q{i}") for i, row in enumerate(qs)],
                                    "query_id bigint, query_vec array<double>, query_text string")
    return queries, vectors, qs, v.astype(np.float32).astype(float)


@pytest.mark.parametrize("limit, block, batch", [(4096, 8192, 10_000), (4096, 8192, 7), (0, 50, 10_000), (0, 7, 10_000)])
def test_candidates_against_brute_force(spark, tables, limit, block, batch):
    queries, vectors, qs, v = tables
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    found = R.candidates(queries, vectors, 4, limit, block).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r.candidate_rank] = r.chunk_key
    for i, q in enumerate(qs):
        scores = np.round(v @ q, 9)
        want = sorted(range(len(v)), key=lambda j: (-scores[j], j))[:20]
        assert [got[i][k + 1] for k in range(20)] == want


def test_small_index_returns_everything(spark, tables):
    queries, vectors, *_ = tables
    few = vectors.filter("chunk_key < 5")
    assert R.candidates(queries, few, 3).groupBy("query_id").count().select("count").distinct().collect() == [(5,)]
    assert R.candidates(queries.limit(0), few, 3).count() == 0


def test_near_ties_are_not_merged(spark):
    """Scores that differ in the last places keep their order, and equal vectors go by key, in any dealing."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    v = np.repeat(base[None], 240, axis=0)
    v[:120] += rng.integers(-3, 4, size=(120, 64)) * 1e-15  # far below nine places
    q = rng.normal(size=(10, 64))
    vectors = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "chunk_key bigint, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)], "query_id bigint, query_vec array<double>")
    def result(limit, rows, parts):
        found = R.candidates(queries, vectors.repartition(parts), 4, limit, rows)
        return sorted((r.query_id, r.candidate_rank, r.chunk_key, r.embedding_score) for r in found.collect())
    want = []
    for i, row in enumerate(q):
        scores = [sum_in_order(row, c) for c in v]
        best = sorted(range(len(v)), key=lambda j: (-scores[j], j))[:20]
        want += [(i, k + 1, j, scores[j]) for k, j in enumerate(best)]
    assert len({s for *_, s in want}) > 20  # distinct scores, all equal at nine places per query
    for limit, rows, parts in [(4096, 4096, 1), (4096, 4096, 7), (0, 1, 3), (0, 3, 5)]:
        assert result(limit, rows, parts) == want


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        total += x * y
    return total


def test_chunks_are_not_shuffled(spark, tables):
    queries, vectors, *_ = tables
    found = R.candidates(queries, vectors, 4, 0, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "embedding#" not in plan.split("Exchange", 1)[1]  # stored results only


@pytest.mark.parametrize("query, title, kind, site, text, gain", [
    ("squat depth", "Squat", "x", "", "", 0.09), ("!!", "Squat", "x", "", "", 0.0), ("what is it", "", "ARTICLE", None, "", 0.05),
    ("a", "", "", "www.BarbellMedicine.com", "", 0.03), ("a", None, None, "", "Welcome back, all", -0.08),
    ("why squat", "squat guide", "article", "pmc.ncbi.nlm.nih.gov", "tier list", 0.09 + 0.05 + 0.03 - 0.08)])
def test_rerank(rows, query, title, kind, site, text, gain):
    df = rows("q string, t string, k string, s string, x string", (query, title, kind, site, text))
    score = R.rerank_score(F.lit(1.0), *[F.col(c) for c in "qtksx"])
    assert abs(df.select(score).first()[0] - 1.0 - gain) < 1e-12


def test_ranks_have_no_gaps_and_scores_descend(spark, tables):
    queries, vectors, *_ = tables
    chunks = vectors.select("chunk_key", F.concat(F.lit("Squat "), "chunk_key").alias("title"), F.lit("Article").alias("type"),
                            F.lit("example.org").alias("website"), F.lit("text").alias("text"))
    by_query = {}
    for r in R.retrieve(queries, vectors, chunks, 3).collect():
        by_query.setdefault(r.query_id, []).append((r["rank"], r.score))
    for found in by_query.values():
        assert [k for k, _ in sorted(found)] == [1, 2, 3]
        scores = [s for _, s in sorted(found)]
        assert scores == sorted(scores, reverse=True)


def test_mean_pool(rows):
    df = rows("k string, embedding array<float>, mask int", ("a", [3.0, 0.0], 1), ("a", [0.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [1.0, 1.0], 0))
    got = {r.k: r.embedding for r in Z.mean_pool(df, "k").collect()}
    assert np.allclose(got["a"], [0.6, 0.8]) and got["b"] == [0.0, 0.0]


def test_encoder_hook(rows):
    got = Z.encode(rows("id int, text string", (1, "abc"), (2, "")), lambda texts: np.array([[len(t), 1.0] for t in texts])).orderBy("id").collect()
    assert np.allclose(got[0].embedding, np.array([3, 1]) / 10 ** 0.5) and np.allclose(got[1].embedding, [0, 1])


def test_hashed_vectors_find_their_own_text(spark, rows):
    docs = rows("chunk_key bigint, text string", (0, "heavy squat depth"), (1, "bench press arch"), (2, "sleep and food"))
    model = Z.fit_hashed_vectorizer(docs, dim=256)
    vectors = Z.hashed_vectors(docs, model)
    queries = Z.hashed_vectors(rows("query_id bigint, query_text string", (7, "squat depth?")), model, "query_text", "query_vec")
    best = R.candidates(queries, vectors, 1).filter("candidate_rank = 1").first()
    assert best.chunk_key == 0


def test_hashed_vectors_by_value(spark):
    """Word counts times rarity at unit length, by hand, with the engine's own places of the words."""
    texts = ["Squat squat depth", "bench depth", "", "Squat 5x5!", "row row row bench"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    model = Z.fit_hashed_vectorizer(docs, dim=64)
    words = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
    place = {w: model.stages[0].indexOf(w) for ws in words for w in ws}
    held = collections.Counter(p for ws in words for p in {place[w] for w in ws})
    got = {r.doc_id: r.embedding for r in Z.hashed_vectors(docs, model).collect()}
    for k, ws in enumerate(words):
        want = np.zeros(64)
        for w in ws:
            want[place[w]] += math.log((len(texts) + 1) / (held[place[w]] + 1))
        length = np.linalg.norm(want)
        assert np.allclose(got[k], want / length if length else want, atol=1e-12)


def test_texts_do_not_travel_with_candidates(spark, tables):
    """Candidates are ranked without the chunks' texts, which meet the best few; weak texts still count."""
    queries, vectors, *_ = tables
    weak = F.col("chunk_key") % 2 == 0
    chunks = vectors.select("chunk_key", F.lit("T").alias("title"), F.lit("x").alias("type"), F.lit("").alias("website"),
                            F.when(weak, "Welcome back, all").otherwise(F.concat(F.lit("text "), "chunk_key")).alias("text"))
    found = R.candidates(queries, vectors, 3)
    got = R.rerank(found, queries, chunks, 3)
    ranked = got._jdf.queryExecution().optimizedPlan().toString().rsplit("Window [row_number()", 2)[1]
    assert not re.search(r"\btext#", ranked.split("Join")[0])
    want, by_query = [], {}
    for r in found.collect():
        by_query.setdefault(r.query_id, []).append((0.08 * (r.chunk_key % 2 == 0) - r.embedding_score, r.candidate_rank, r.chunk_key))
    for query, rows in by_query.items():
        want += [(query, place, key, "Welcome back, all" if key % 2 == 0 else f"text {key}") for place, (*_, key) in enumerate(sorted(rows)[:3], 1)]
    assert sorted((r.query_id, r["rank"], r.chunk_key, r.text) for r in got.collect()) == sorted(want)
