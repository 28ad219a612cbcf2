import random

import pytest
from pyspark.sql import functions as F

from setledger.operators import documents as D


@pytest.mark.parametrize("n, size, overlap", [
    (0, 180, 40), (1, 180, 40), (180, 180, 40), (181, 180, 40), (320, 180, 40), (321, 180, 40), (2000, 180, 40),
    (7, 3, 3), (7, 3, 9), (5, 1, 0)])
def test_chunks(rows, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    got = D.chunk_words(rows("doc_id int, text string", (1, "  ".join(words))), size, overlap).orderBy("chunk_index").collect()
    step, want, at = max(1, size - overlap), [], 0
    while at < n:
        want.append(" ".join(words[at:at + size]))
        if at + size >= n:
            break
        at += step
    assert [r.text for r in got] == want
    assert [r.n_words for r in got] == [len(w.split()) for w in want]


HEADER = "TITLE: T \nAUTHOR:A, B\nWEBSITE: w\nURL: u\nTYPE: Article\nunseen\n body\r\nmore\n"


@pytest.mark.parametrize("raw, expected", [
    (HEADER, ("T", "A, B", "w", "u", "Article", "body\nmore")),
    ("TITLE: T\nAUTHOR: A\nSITE: w\nURL: u\nTYPE: X\n\nbody", ("T", "A", "", "", "", "TITLE: T\nAUTHOR: A\nSITE: w\nURL: u\nTYPE: X\n\nbody")),
    ("TITLE: T\nAUTHOR: A", ("", "", "", "", "", "TITLE: T\nAUTHOR: A")),
    ("TITLE: T\nAUTHOR: A\nWEBSITE: w\nURL: u\nTYPE: X\nonly six", None),
    ("[ERROR] no", None), (" \n ", None), ("plain", ("", "", "", "", "", "plain")),
    ("\x1cTITLE: T\x85AUTHOR: A\x0cWEBSITE: w URL: u\x1eTYPE: X\r\n\r\nbody", ("T", "A", "w", "u", "X", "body"))])
def test_header(rows, raw, expected):
    got = [tuple(r) for r in D.parse_header(rows("raw_text string", (raw,))).select("title", "author", "website", "url", "type", "text").collect()]
    assert got == ([] if expected is None else [expected])


def test_record_and_header_are_inverse(rows):
    df = rows("title string, author string, website string, url string, type string, text string",
              ("T", None, "w", "u", "Video", "a\nb"), ("x", "y", "z", "u", "Article", "[ERROR] x"), ("x", "y", "z", "u", "Article", ""))
    record = D.document_record(F.col("text"), **{c: F.col(c) for c in D.DOCUMENT_FIELDS})
    stored = df.select(record.alias("raw_text"))
    assert stored.filter("raw_text IS NULL").count() == 2
    got = D.parse_header(stored.filter("raw_text IS NOT NULL")).first()
    assert (got.title, got.author, got.website, got.url, got.type, got.text) == ("T", "", "w", "u", "Video", "a\nb")


@pytest.mark.parametrize("bound", [3, 2_000_000])
def test_chunk_numbers(spark, monkeypatch, bound):
    from setledger.operators import ordering
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", bound)
    rng = random.Random(1)
    docs = [(f"f{i % 2}", f"n{i:02d}", " ".join("w" for _ in range(rng.randrange(30)))) for i in range(20)]
    docs = spark.createDataFrame(docs, "folder string, source_name string, text string")
    got = D.chunk_numbers(docs, ["folder", "source_name"], 5, 2).orderBy("folder", "source_name", "chunk_index").collect()
    assert [r.chunk_id for r in got] == list(range(len(got))) and len(got) > 40
    cut = {(r.folder, r.source_name, r.chunk_index): r.n_words for r in D.chunk_words(docs, 5, 2).collect()}
    assert {(r.folder, r.source_name, r.chunk_index): r.n_words for r in got} == cut


def test_numbering_shuffles_no_text(spark):
    docs = spark.createDataFrame([(k, "some words here " * k) for k in range(9)], "doc_id int, text string")
    numbers = D.chunk_numbers(docs, ["doc_id"], 5, 2)
    assert "text#" not in numbers._jdf.queryExecution().executedPlan().toString()


def test_stats(rows):
    got = D.index_stats(rows("doc_id int, chunk_index int", (1, 0), (1, 1), (2, 0))).first()
    assert (got.num_files, got.num_chunks) == (2, 3)
