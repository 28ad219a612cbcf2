"""Near duplicates, repeated lines and the pipeline against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from setledger.llm import line_duplicates as lines, linkage, near_duplicates as near
from setledger.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def root_of(parents, x):
    while parents[x] != x:
        x = parents[x]
    return x


def brute_components(texts):
    """doc_id -> smallest doc_id reachable, from all pairs of sets."""
    sets = {}
    for i, text in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets[i] = {tuple(words[k:k + 4]) for k in range(len(words) - 3)} or ({tuple(words)} if words else set())
    parents = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root_of(parents, a), root_of(parents, b)))
                parents[y] = x
    return {i: root_of(parents, i) for i in sets}, {i: len(s) for i, s in sets.items()}


def check(docs):
    rows = near.near_duplicates(docs).collect()
    want, sizes = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in rows} == want
    assert {r.doc_id: r.n_shingles for r in rows} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_brute_force(spark):
    check(table(spark, FOLDER, "documents"))


def test_chain_and_group_of_near_copies(rows):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    made = [(i, " ".join(rng.choice(["x", "y", w]) if rng.random() < 0.02 else w for w in base)) for i in range(60)]
    made += [(100 + i, " ".join(f"c{k}" for k in range(i * 6, i * 6 + 100))) for i in range(12)]  # each near the next
    made += [(200, None), (201, ""), (202, " \n"), (203, "Two words"), (204, "two WORDS"), (205, "a b c d")]
    check(rows("doc_id long, text string", *made))


def test_near_duplicates_odd_rows(rows, spark):
    docs = rows("doc_id long, text string, key string, node long", (1, "a b c d e", "k", 1), (1, "a b c d e", "k", 1),
                (None, "a b c d e", "k", 2), (2, "long " * 50_000, "k", 3), (None, None, None, None), (1, "q r s t", "k", 4))
    got = sorted(map(tuple, near.near_duplicates(docs).collect()), key=repr)
    assert len(got) == 6 and (None, 2, 1, False) in got and got.count((1, 2, 1, True)) == 2 and (2, 1, 2, True) in got
    assert [r.text for r in near.one_of_each(docs).orderBy("text").collect()] == [None, "a b c d e", "long " * 50_000, "q r s t"]
    none = spark.createDataFrame([], docs.schema)
    assert near.near_duplicates(none).count() == 0 and near.one_of_each(none).count() == 0


def test_components(rows):
    links = rows("a long, b long", (1, 2), (2, 3), (3, 9), (20, 21), (9, 40), (40, 41), (5, 5))
    got = {r.node: r.root for r in linkage.components(links).collect()}
    assert len({got[n] for n in (1, 2, 3, 9, 40, 41)}) == 1 and got[20] == got[21] != got[1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        k, kind = rng.randrange(len(out) or 1), rng.random()
        if kind < 0.34 or not out:
            out.insert(k, rng.choice("abc"))
        elif kind < 0.67:
            out.pop(k)
        else:
            out[k] = rng.choice("abc")
    return "".join(out)


def test_within():
    rng = random.Random(1)
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        b = edited(rng, a + "a", rng.randint(0, 4))
        assert all(lines.within(a, b, k) == (distance(a, b) <= k) for k in range(4))


def brute_dropped(docs):
    seen = [(d, n, raw.strip(lines.BLANKS)) for d, text in docs for n, raw in enumerate((text or "").split("\n"))]
    seen = [s for s in seen if len(s[2]) >= lines.MIN_CHARS]
    kinds = sorted({s[2] for s in seen})
    parents = {k: k for k in kinds}
    for x in range(len(kinds)):
        for y in range(x):
            a, b = kinds[x], kinds[y]
            k = int(lines.budget(min(len(a), len(b))))
            if k and abs(len(a) - len(b)) <= k and distance(a, b) <= k:
                parents[root_of(parents, a)] = root_of(parents, b)
    first = {}
    for d, n, line in sorted(seen):
        first.setdefault(root_of(parents, line), (d, n))
    return {(d, n) for d, n, line in seen if first[root_of(parents, line)] != (d, n)}


def test_lines_brute_force(rows):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(n)).strip() + "z" for n in (20, 33, 40, 70, 95, 96, 120, 200)]
    docs = [(d, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 3])) if rng.random() < 0.7 else f"line {rng.random()} of {d}"
                          for _ in range(rng.randint(1, 5)))) for d in range(50)]
    got = {(r.doc_id, n) for r in lines.line_report(rows("doc_id long, text string", *docs)).collect() for n in r.dropped_lines}
    assert got == brute_dropped(docs)


def test_lines_odd_rows(rows, spark):
    line = "a line that is repeated"
    docs = rows("doc_id long, text string, node long, line string", (1, f"{line}\nshort\n\nother words of one", 1, "a"),
                (2, f"  {line}\t\nshort\nmore words of two", 1, "b"), (3, line, 1, "c"), (3, line, 1, "c"), (None, line + "\nown words of none", 1, "d"),
                (4, None, 1, "e"), (5, "", 1, "f"), (6, "z" * 100_000, 1, "g"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, list(r.dropped_lines), list(r.class_docs)) for r in lines.line_report(docs).collect()}
    assert got[1] == (4, 0, [], []) and got[2] == (3, 1, [0], [1]) and got[3] == (1, 1, [0], [1])
    assert got[None] == (2, 1, [0], [1]) and got[4] == (0, 0, [], []) and got[5] == (1, 0, [], [])
    left = {r.doc_id: r.text for r in lines.without_repeated_lines(docs).collect()}
    assert set(left) == {1, 2, None, 4, 5, 6} and left[2] == "short\nmore words of two" and left[None] == "own words of none"
    assert lines.without_repeated_lines(spark.createDataFrame([], docs.schema)).columns == docs.columns
    assert lines.line_report(spark.createDataFrame([], docs.schema)).count() == 0


def test_filter_lets_wanted_lines_pass(rows):
    docs = rows("doc_id long, text string", *[(i, f"this is the line with number {i} of the test") for i in range(300)])
    nodes = lines.line_occurrences(docs).select("node").distinct()
    assert lines.wanted_lines(docs, nodes.limit(40)).count() == 40


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, FOLDER, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(linkage.pin(stage(spark, out[-1], FOLDER)))
    return out


def test_stages_against_brute_force(spark, stages):
    docs, clean, cut, single, safe = stages
    assert all(s.columns == docs.columns for s in stages)
    kept = {r.doc_id for r in clean.collect()}
    marks = {r.doc_id: r.toxic for r in table(spark, FOLDER, "labels").collect()}
    assert kept <= {r.doc_id for r in docs.collect()} and sum(marks.get(d) == 0 for d in kept) >= 0.95 * sum(m == 0 for m in marks.values())
    before = [(r.doc_id, r.text) for r in clean.collect()]
    dropped = brute_dropped([(d, t) for d, t in before])
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in dropped) for d, t in before}
    assert {r.doc_id: r.text for r in cut.collect()} == {d: t for d, t in want.items() if t.strip() or not dict(before)[d].strip()}
    component, _ = brute_components([(r.doc_id, r.text) for r in cut.collect()])
    assert {r.doc_id for r in single.collect()} == {d for d, c in component.items() if d == c}
    items = [r.text for r in table(spark, FOLDER, "benchmark").collect()]
    left = {r.doc_id: r.text for r in safe.collect()}
    assert not [d for d, t in left.items() if any(x in t for x in items)]
    assert len(left) > 0.9 * single.count()


def test_pipeline_runs(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.count() == stages[-1].count() and got.filter("taken > 3 * size").isEmpty()
    assert got.agg(F.sum("taken")).first()[0] > 0
