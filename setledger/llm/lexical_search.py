"""Ranked lexical search: the best documents for each query text, by best-first search over document intervals.

One pass over the texts stores a forward index: each document's length and how often it holds each query term. Sums
over it give the collection's figures (documents, terms, documents per term). A second pass reads the index in
shards of at most ``SHARD_POSTINGS`` postings, and per shard:

* turns it into posting lists in document order, with the exact integer impact of every posting, and range-maximum
  sparse tables over them (the place of the greatest impact in any range of a list, from two look-ups);
* searches all queries best first. An interval of documents is bounded by the sum of its lists' maxima. The interval
  with the greatest bound is split at the document that holds the greatest single maximum: that document is scored in
  full, the parts left and right of it get bounds of their own. A query is done when no open interval can reach its
  last place. Documents stand in order of their ids, so equal scores are settled by position, and a group of copies is
  left after its first members.

Each shard returns its best ``TOP`` per query; a ranking that keeps ``TOP`` rows per query and task merges them. The
impacts are known before the search, so merging shards is exact.

Only the queries of one block (about ``BLOCK_CHARS`` characters) are sent to tasks. More queries are dealt into more blocks,
each with its own pass over the documents.

Defined results: null, empty and term-free texts match nothing and do not count as documents; a query without terms,
or whose terms no document holds, returns nothing; rows that repeat an item_id or a doc_id are rows of their own; a
null doc_id ranks last among equal scores; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from setledger.session import pin

TOP = 20
SHARD_POSTINGS = 2_000_000
BLOCK_CHARS = 4_000_000

#: Intervals that a query takes from its heap per round; the rounds of all queries are worked on together.
_POPS = 8
#: The terms of the contract in lower-cased UTF-8: bytes from 0x80 on belong to characters beyond ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms_of(text: str | None) -> list[bytes]:
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def query_blocks(queries: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """(item_id, text) of the queries, in blocks dealt by hash that hold about half of ``chars`` characters."""
    rows = pin(queries.select("item_id", "text"))
    blocks = 1 + 2 * (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // chars
    for number in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        if mine:
            yield [tuple(r) for r in mine]


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), and the numbers and counts of the vocabulary's terms, of every document with a term;
    stored."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                found = terms_of(text)
                if found:
                    known = Counter(map(vocabulary.get, found))
                    known.pop(None, None)
                    out.append((doc_id, len(found), list(known), list(known.values())))
            yield pd.DataFrame(out, columns=["doc_id", "n", "terms", "counts"])

    # ids travel as text: pandas would turn a column of numbers with nulls into floats
    return pin(docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        work, "doc_id string, n long, terms array<int>, counts array<int>"))


class Shard:
    """Posting lists of some documents and their sparse tables. Documents are numbered in order of their ids, which
    are whole numbers as text."""

    def __init__(self, docs: pd.DataFrame, weights: np.ndarray, documents: int, length: int) -> None:
        order = sorted(range(len(docs)), key=[(i is None, int(i or 0)) for i in docs["doc_id"]].__getitem__)
        docs = docs.iloc[order]
        self.ids, self.size = docs["doc_id"].to_numpy(), len(docs)
        each = docs["terms"].str.len().to_numpy(np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *docs["terms"]]).astype(np.int64)
        count = np.concatenate([np.zeros(0, np.int64), *docs["counts"]]).astype(np.int64)
        doc = np.repeat(np.arange(self.size), each)
        order = np.argsort(term, kind="stable")  # documents stay in order within a term
        term, count, self.doc = term[order], count[order], doc[order]
        mass = 75 + 25 * docs["n"].to_numpy(np.int64) * documents // length
        self.impact = weights[term] * (1_000_000_000 * count // (1_000 * count + 12 * mass[self.doc]))
        self.key = term * self.size + self.doc
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        self.best = [np.arange(len(term), dtype=np.int32)]
        longest, width = int(np.diff(self.start).max(initial=0)), 1
        while 2 * width <= longest:
            low = self.best[-1]
            left, right = low[:-width], low[width:]
            self.best.append(np.where(self.impact[right] > self.impact[left], right, left))
            width *= 2

    def peak(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the greatest impact of each range of postings is, the first of equals. No range is empty."""
        out = np.empty(len(low), np.int64)
        level = np.frexp(high - low)[1] - 1
        for k in range(len(self.best)):
            at = np.flatnonzero(level == k)
            if len(at):
                left, right = self.best[k][low[at]], self.best[k][high[at] - (1 << k)]
                out[at] = np.where(self.impact[right] > self.impact[left], right, left)
        return out

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], top: int = TOP) -> list[list[tuple[int, int]]]:
        """For each query (term numbers, how often each stands in it) its best (score, document), best first."""
        heaps: list[list] = [[] for _ in queries]
        best: list[list] = [[] for _ in queries]
        # an interval: query, first document, end, and per term its number, its times in the query and its postings' range
        fresh = [(q, 0, self.size, np.stack([terms, times, self.start[terms], self.start[terms + 1]]))
                 for q, (terms, times) in enumerate(queries) if len(terms)]
        while fresh:
            self._bound(fresh, heaps)
            taken = []
            for q in {f[0] for f in fresh}:
                heap, found = heaps[q], best[q]
                for _ in range(_POPS):
                    if not heap or (len(found) == top and (-heap[0][0], -heap[0][1]) < found[0]):
                        break
                    taken.append((q, *heapq.heappop(heap)[1:]))
            fresh = self._split(taken, best, top) if taken else []
        return [sorted(((s, -d) for s, d in found), key=lambda x: (-x[0], x[1])) for found in best]

    def _bound(self, fresh: list[tuple], heaps: list) -> None:
        """Push each interval that still holds a posting, with its bound and the document that splits it."""
        lists = np.concatenate([f[3] for f in fresh], axis=1)
        owner = np.repeat(np.arange(len(fresh)), [f[3].shape[1] for f in fresh])
        keep = lists[3] > lists[2]
        lists, owner = lists[:, keep], owner[keep]
        if not len(owner):
            return
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        ends = np.append(starts[1:], len(owner))
        peak = self.peak(lists[2], lists[3])
        worth = self.impact[peak] * lists[1]
        bound, greatest = np.add.reduceat(worth, starts), np.maximum.reduceat(worth, starts)
        firsts = np.flatnonzero(worth == np.repeat(greatest, ends - starts))
        middle = self.doc[peak[firsts[np.searchsorted(firsts, starts)]]]
        for f, b, m, at, end in zip(owner[starts].tolist(), bound.tolist(), middle.tolist(), starts.tolist(), ends.tolist()):
            if b > 0:
                q, low, high, _ = fresh[f]
                heapq.heappush(heaps[q], (-b, low, high, m, lists[:, at:end]))

    def _split(self, taken: list[tuple], best: list, top: int) -> list[tuple]:
        """Score each interval's document, and return what lies left and right of it."""
        lists = np.concatenate([t[4] for t in taken], axis=1)
        lengths = np.array([t[4].shape[1] for t in taken])
        ends = np.cumsum(lengths)
        middle = np.repeat(np.array([t[3] for t in taken]), lengths)
        at = np.searchsorted(self.key, lists[0] * self.size + middle)
        place = np.minimum(at, lists[3] - 1)  # a list that ends before the document has no hit
        hit = self.doc[place] == middle
        score = np.add.reduceat(np.where(hit, self.impact[place] * lists[1], 0), ends - lengths)
        left, right = np.concatenate([lists[:3], at[None]]), np.stack([*lists[:2], at + hit, lists[3]])
        out = []
        for t, s, a, b in zip(taken, score.tolist(), (ends - lengths).tolist(), ends.tolist()):
            q, low, high, m = t[:4]
            if len(best[q]) < top:
                heapq.heappush(best[q], (s, -m))
            elif (s, -m) > best[q][0]:
                heapq.heapreplace(best[q], (s, -m))
            if low < m:
                out.append((q, low, m, left[:, a:b]))
            if m + 1 < high:
                out.append((q, m + 1, high, right[:, a:b]))
        return out


def shard_results(index: DataFrame, queries: list[tuple], weights: np.ndarray, documents: int, length: int, item_type: str,
                  top: int = TOP, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(q, item_id, doc_id, score): each shard's best documents of each query (item_id, terms, counts)."""
    asked = [(terms, times) for _, terms, times in queries]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(parts: list[pd.DataFrame]) -> pd.DataFrame:
            shard = Shard(pd.concat(parts, ignore_index=True), weights, documents, length)
            rows = [(q, d, s) for q, hits in enumerate(shard.search(asked, top)) for s, d in hits if s > 0]
            number, doc, score = (np.array([r[k] for r in rows], np.int64) for k in range(3))
            return pd.DataFrame({"q": number, "item_id": pd.Series([queries[q][0] for q in number], dtype=object),
                                 "doc_id": shard.ids[doc], "score": score})

        parts, held = [], 0
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                part = batch.iloc[at:at + 2_000]
                size = int(part["terms"].str.len().sum())
                if parts and held + size > shard_postings:
                    yield found(parts)
                    parts, held = [], 0
                parts, held = parts + [part], held + size
        if parts:
            yield found(parts)

    return index.mapInPandas(work, f"q long, item_id {item_type}, doc_id string, score long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, chars: int = BLOCK_CHARS,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id and score of the best ``top`` documents of each query."""
    item_type = queries.schema["item_id"].dataType.simpleString()
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")
    for block in query_blocks(queries, chars):
        counts = [Counter(terms_of(text)) for _, text in block]
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        index = forward_index(docs, vocabulary)
        sums = index.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not sums.documents or not vocabulary:
            continue
        held = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row a term of the block
        weights = np.zeros(len(vocabulary), np.int64)
        for row in held:
            weights[row.term] = math.floor(1000 * math.log((2 * sums.documents + 2) / (2 * row["count"] + 1)))
        asked = [(item, np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64))
                 for (item, _), c in zip(block, counts)]
        found = shard_results(index, asked, weights, sums.documents, sums.length, item_type, top, shard_postings)
        place = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("doc_id", F.col("doc_id").cast(doc_type)).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out


def search_sql() -> str:
    """The same rows by scoring every document, in DuckDB's SQL."""
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS t FROM documents),
q AS (SELECT row_number() OVER () AS q, item_id, {words} AS t FROM benchmark),
facts AS (SELECT count(*)::BIGINT AS c, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
held AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d)
         WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM held, facts GROUP BY term, c),
scores AS (SELECT q, item_id, r, doc_id,
                  sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c) // l))))::BIGINT AS score
           FROM asked JOIN held USING (term) JOIN weights USING (term), facts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
