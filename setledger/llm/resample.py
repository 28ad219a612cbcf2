"""Importance resampling towards the text of a target table, drawn by a distributed radix sort.

Every run of one to three words is a feature, hashed into ``BUCKETS`` buckets. A bucket's gain is the log ratio of
its smoothed share in the target to its share in the documents, in thousandths. A document's weight is the sum of
gains over its features, read from one array of ``BUCKETS`` numbers; a random term per document (Gumbel, from a hash
of its id) is added, and the highest scores are drawn.

The order is found by a least-significant-digit radix sort over the composite key (score falling, doc_id rising,
n_features rising), 16 bits a pass. A pass is a stable counting sort on tables: rows stand in blocks of ``BLOCK``
positions; counts per (digit, block) are summed to global prefix offsets (a base per digit, a running sum over the
blocks of that digit); a row's destination is its offset plus its place among the rows of its own digit in its block. Each
pass is written as a table and read again, so a lost executor costs at most one pass. Digits that all rows share are
skipped. After the last pass a row's position is its rank. No task holds more than a block's rows of one digit.

Defined results: null, empty and wordless texts have no features, weight 0, and are never drawn (fewer than
``MIN_WORDS`` words); a null doc_id is hashed as the text ``null`` and loses ties; rows that repeat an id are rows of
their own, those with equal scores in the order of their features; an empty table gives an empty result, an empty target
counts as a target without features; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from setledger.llm.common import slices
from setledger.session import pin

BUCKETS = 10_000
RUN_WORDS = 3
SEED = "42"
MIN_WORDS = 20
DRAW_PERCENT = 5

DIGIT_BITS = 16
BLOCK = 1 << 16

#: ALNUM_WORD of the contracts in lower-cased UTF-8: bytes from 0x80 on belong to characters beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words up to this many bytes are joined by table; longer ones are rare and hashed as they stand.
_LONGEST = 255


@lru_cache(maxsize=1)
def _after_zeros() -> np.ndarray:
    """[n, k, v]: what byte k = v of a checksum becomes when n zero bytes follow. Checksums are linear, so the
    checksum of a join is the left one moved past the right part's length, xor the right one."""
    step = np.array([zlib.crc32(bytes([v])) ^ zlib.crc32(b"\0") for v in range(256)], np.uint32)
    out = np.zeros((_LONGEST + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, len(out)):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & 255]
    return out


def _joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of left + right, where right has ``length`` bytes."""
    moved = _after_zeros()
    out = right.copy()
    for k in range(4):
        out ^= moved[length, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def feature_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words per text, the texts' numbers word by word, and for runs of 1, 2 and 3 words the bucket of the run that
    ends at each word; -1 where the text has no such run."""
    words, counts = [], []
    for text in texts:
        found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
        words += found
        counts.append(len(found))
    counts = np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    single = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    long = length > _LONGEST
    length[long] = 0
    spaced = _joined(np.full(len(words), zlib.crc32(b" "), np.uint32), single, length)
    runs, run = [single.astype(np.int64) % BUCKETS], single
    for size in range(2, RUN_WORDS + 1):
        before = np.roll(run, 1)
        run = _joined(before, spaced, length + 1)
        whole = owner == np.roll(owner, size - 1)
        whole[:size - 1] = False
        for at in sorted({a + k for a in np.flatnonzero(long).tolist() for k in range(size) if a + k < len(words)}):
            run[at] = zlib.crc32(b" ".join(words[max(0, at - size + 1):at + 1]))
        runs.append(np.where(whole, run.astype(np.int64) % BUCKETS, -1))
    return counts, owner, runs


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) over all texts; tasks count first, so only ``BUCKETS`` rows a task are shuffled."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for run in feature_buckets(part["text"].tolist())[2]:
                    total += np.bincount(run[run >= 0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return texts.select("text").mapInPandas(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket: ``BUCKETS`` numbers, whatever the tables' sizes."""
    counts = bucket_counts(docs).withColumnRenamed("n", "s").join(
        bucket_counts(target).withColumnRenamed("n", "t"), "bucket", "full_outer")
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():
        s[row.bucket], t[row.bucket] = row.s or 0, row.t or 0
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def luck(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) of a number u in (0, 1) that the id's hash names."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weighted(docs: DataFrame, gains: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.array([*gains, 0], np.int64)  # -1 reads the zero at the end
        for batch in batches:
            for part in slices(batch, "text"):
                counts, owner, runs = feature_buckets(part["text"].tolist())
                sums = np.concatenate([[0], np.cumsum(sum(table[run] for run in runs))])
                ends = np.cumsum(counts)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "n_words": counts,
                    "n_features": sum(np.maximum(counts - k, 0) for k in range(RUN_WORDS)),
                    "weight": sums[ends] - sums[ends - counts]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    # ids travel as text: pandas would turn a column of numbers with nulls into floats
    rows = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(
        work, "doc_id string, n_words long, n_features long, weight long").withColumn("doc_id", F.col("doc_id").cast(kind))
    return rows.withColumn("score", F.col("weight") + luck(F.col("doc_id")))


def key_digits(rows: DataFrame) -> list[Column]:
    """Digits of (score falling, doc_id rising with null last, n_features rising), the least significant first;
    those in which all rows agree are left out."""
    top = rows.agg(F.max("score")).first()[0]
    if top is None:
        return []
    sign = F.lit(-2**63)  # with its sign bit turned, a signed number sorts as an unsigned one
    fields = [F.col("n_features"), F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(sign), F.lit(0)),
              F.col("doc_id").isNull().cast("long"), F.lit(top) - F.col("score")]
    parts = [F.shiftrightunsigned(f, at).bitwiseAND(F.lit(2**DIGIT_BITS - 1)) for f in fields for at in range(0, 64, DIGIT_BITS)]
    ends = rows.agg(*[F.min(p).alias(f"low{i}") for i, p in enumerate(parts)],
                    *[F.max(p).alias(f"high{i}") for i, p in enumerate(parts)]).first()
    return [p for i, p in enumerate(parts) if ends[f"low{i}"] != ends[f"high{i}"]]


def counting_pass(rows: DataFrame, digit: Column, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``pos`` replaced by each row's place after a stable sort by ``digit``."""
    cut = rows.withColumns({"_digit": digit, "_block": F.floor(F.col("pos") / block).cast("long")})
    counts = cut.groupBy("_digit", "_block").agg(F.count("*").alias("n"))
    blocks = W.partitionBy("_digit").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    within = counts.withColumn("_before", F.coalesce(F.sum("n").over(blocks), F.lit(0)))
    bases = counts.groupBy("_digit").agg(F.sum("n").alias("n")).select(  # one row a digit: 65,536 at most
        "_digit", F.coalesce(F.sum("n").over(W.orderBy("_digit").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    offsets = within.join(bases, "_digit").select("_digit", "_block", (F.col("_before") + F.col("_base")).alias("_offset"))
    place = F.row_number().over(W.partitionBy("_digit", "_block").orderBy("pos"))
    return cut.withColumn("_place", place).join(offsets.hint("merge"), ["_digit", "_block"]).select(
        *[c for c in rows.columns if c != "pos"], (F.col("_offset") + F.col("_place") - 1).cast("long").alias("pos"))


def radix_sorted(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``pos``: 0 for the first in the order of the composite key. The result is stored."""
    state = pin(rows.withColumn("pos", F.monotonically_increasing_id()))
    for digit in key_digits(state) or [F.lit(0)]:
        state = pin(counting_pass(state, digit, block))
    return state


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS,
             block: int = BLOCK) -> DataFrame:
    """doc_id, n_features, weight, score and rank (from 1; null where not drawn) of every document."""
    scored = pin(weighted(docs, bucket_gains(docs, target)))
    can = F.col("n_words") >= min_words
    drawn = scored.filter(can).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = radix_sorted(scored.filter(can).select(*columns), block).select(
        *columns, F.when(F.col("pos") < drawn, F.col("pos") + 1).alias("rank"))
    return ranked.unionByName(scored.filter(~can).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample_sql() -> str:
    """The same rows in DuckDB's SQL; it has no crc32, which is folded from a table of 256 entries."""
    return """
WITH tbl AS (SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, k:
             CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS t),
words AS (
  SELECT 0 AS side, doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, NULL, -row_number() OVER (),
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
runs AS (
  SELECT side, r, unnest(w) AS f FROM words
  UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words),
features AS (SELECT side, r, f, count(*) AS n FROM runs GROUP BY ALL),
buckets AS (
  SELECT f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i:
                 ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), tbl),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
           FROM features JOIN buckets USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE)
                 / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features
            FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS n_words,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place
           FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank
FROM ranked"""
