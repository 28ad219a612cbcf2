"""Mixing sources to target weights with a low-discrepancy schedule.

Every source is shuffled (rows in the order of a hash of their id) and cut into blocks of equally many
tokens. Slot ``i`` of the mix has the golden-ratio point ``frac((i + 1) * phi)``; the point falls into
one interval of the cumulative target weights and so names a source. The k-th slot of a source takes
its k-th block, starting over when the source is used up, until the source's target is met; the last
block is cut so that the target is met to the word. A source that the finite point set serves a few
slots short gets them at the end of the mix.

DataFrame operations only. Text is read once, for the sizes; ranks and running totals are taken within
cells of bounded size and shifted by the totals of earlier cells, so a source that holds most rows is
spread over many tasks.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its
own, last in order; repeated rows are separate rows; an empty table gives an empty mix; columns other
than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from setledger.llm.common import BLANK_WORD
from setledger.session import pin

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
ROWS_PER_CELL = 20_000
GOLDEN = 0.6180339887498949


def sized_rows(docs: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """One stored row per document: row_id, doc_id, source, size (words) and the hash that shuffles."""
    return pin(docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(BLANK_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle")))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source_no (code point order, null last), source_size, weight, target, lo, hi.

    ``target = least(repeats * size, level * weight)``, where ``level`` makes the targets add up to all
    words; it is found by going through the sources in the order in which they reach their limit.
    [lo, hi) is the source's share of the unit interval. Rows are sources, already summed.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = totals.withColumn("source_no", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")))
    limit = (F.col("source_size") * repeats).cast("double")
    by_limit = W.orderBy(limit / F.col("weight"), "source_no")
    earlier = by_limit.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    # the level if exactly the earlier sources stand at their limit
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("source_size").over(earlier), F.lit(0)) * repeats)
             .cast("double") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))))
    tried = listed.withColumn("try", level).withColumn("limit", limit)
    fits = F.when(F.col("try") * F.col("weight") <= F.col("limit"), F.col("try"))
    chosen = tried.withColumn("level", F.max(fits).over(whole))
    target = F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit"))
    out = chosen.withColumn("target", target)
    share = F.col("target") / F.sum("target").over(whole)
    upto = F.sum("target").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum("target").over(whole)
    return out.withColumns({"hi": upto, "lo": upto - share, "quota": F.floor(F.col("target") + 0.5).cast("long")}).select(
        "source_no", "source", "source_size", "weight", "target", "quota", "lo", "hi")


def schedule(spark, slots: int, targets: DataFrame, block: int, cells: int, slots_per_cell: int = 1 << 16) -> DataFrame:
    """(slot, source_no, rank): which source each slot names and the slot's rank among its source's.

    The points are even over the unit interval, so the join on the interval's cell is even too. A
    source's range of cells is exploded on the small side."""
    width = 1.0 / cells
    ranges = targets.filter("quota > 0").select(
        "source_no", "lo", "hi",
        F.explode(F.sequence(F.greatest(F.floor(F.col("lo") / width) - 1, F.lit(0)), F.least(F.floor(F.col("hi") / width) + 1, F.lit(cells)))).alias("cell"))
    # the product is cut in two so that the fraction stays exact for long schedules
    i = F.col("id") + 1
    high, low = F.floor(i / 65536).cast("double"), (i % 65536).cast("double")
    step = (65536 * GOLDEN) % 1.0
    point = F.pmod(F.pmod(high * step, F.lit(1.0)) + F.pmod(low * GOLDEN, F.lit(1.0)), F.lit(1.0))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn(
        "cell", F.floor(F.col("u") / width))
    named = points.join(ranges, "cell").filter("u >= lo AND u < hi").select("slot", "source_no").withColumn(
        "chunk", F.floor(F.col("slot") / slots_per_cell))
    within = named.withColumn("at", F.row_number().over(W.partitionBy("chunk", "source_no").orderBy("slot")) - 1)
    counts = named.groupBy("chunk", "source_no").agg(F.count("*").alias("n"))
    before = counts.select("chunk", "source_no", F.coalesce(F.sum("n").over(
        W.partitionBy("source_no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return within.join(before, ["chunk", "source_no"]).select("slot", "source_no", (F.col("at") + F.col("before")).alias("rank"))


def pieces(sized: DataFrame, targets: DataFrame, block: int, rows: int, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Each row's stretch of its shuffled source, cut at block borders: row_id, source_no, block,
    lo, hi (word offsets in the source)."""
    cells = max(1, -(-rows // rows_per_cell))
    keyed = sized.filter("size > 0").withColumn(
        "cell", F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * cells / 4294967296))
    keyed = keyed.join(targets.select("source", "source_no"), keyed["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    within = keyed.withColumn("upto", F.sum("size").over(
        W.partitionBy("source_no", "cell").orderBy("shuffle", "size", "row_id").rowsBetween(W.unboundedPreceding, 0)))
    sums = keyed.groupBy("source_no", "cell").agg(F.sum("size").alias("n"))
    before = sums.select("source_no", "cell", F.coalesce(F.sum("n").over(
        W.partitionBy("source_no").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = within.join(before, ["source_no", "cell"]).select(
        "row_id", "source_no", (F.col("before") + F.col("upto") - F.col("size")).alias("start"),
        (F.col("before") + F.col("upto")).alias("end"))
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")))
    return cut.select("row_id", "source_no", "block", F.greatest("start", F.col("block") * block).alias("lo"),
                      F.least("end", (F.col("block") + 1) * block).alias("hi"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = MAX_REPEATS,
                slots_per_row: int = 2, slots_per_source: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as rows (slot, source_no, row_id, from_word, to_word), plus the sized rows and the source table.

    A slot is ``null`` where the points gave its source too few slots: those blocks come last. The
    number of slots is about ``slots_per_row`` for each document.
    """
    spark = docs.sparkSession
    sized = sized_rows(docs)
    n_rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = pin(source_targets(sized, weights, repeats))
    n_sources = targets.count()
    block = max(1, words // max(1, slots_per_row * n_rows + slots_per_source * n_sources))
    slots = -(-words // block)
    points = schedule(spark, slots, targets, block, cells=max(1024, 4 * n_sources))
    cut = pieces(sized, targets, block, n_rows)
    # a source's quota in whole passes and a rest; the rest ends inside block rest / block
    per_source = targets.filter("quota > 0").selectExpr(
        "source_no", "source_size", f"(source_size + {block - 1}) div {block} AS blocks", "quota div source_size AS passes",
        "quota % source_size AS rest")
    uses = cut.join(per_source, "source_no").withColumn(
        "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes")))).withColumn(
        "to_word", F.when(F.col("pass") < F.col("passes"), F.col("hi")).otherwise(F.least("hi", "rest"))).filter(
        "to_word > lo").withColumn("rank", F.expr("pass * blocks + block"))
    mixed = uses.join(points, ["source_no", "rank"], "left")
    return mixed.select("slot", "source_no", "row_id", F.col("lo").alias("from_word"), "to_word"), sized, targets


def taken_words(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words that the mix takes from it."""
    mixed, sized, targets = mix_sources(docs)
    taken = mixed.groupBy("row_id").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    named = sized.select("row_id", "doc_id", "source", "size").join(taken, "row_id", "left")
    return named.join(targets.select(F.col("source").alias("name"), "source_size", "target"),
                      F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def taken_sql(documents: str = "documents") -> str:
    """The same rows in closed form: whole passes, and the overlap with the last pass's stretch.

    ``documents`` names the table that holds doc_id, text and source."""
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS shuffle FROM {documents}),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE source_no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, (3 * source_size)::DOUBLE AS top FROM totals),
tried AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - 3 * coalesce(sum(source_size) OVER (ORDER BY top / weight, source_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
            / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER (ORDER BY top / weight, source_no
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS attempt FROM weighed),
levelled AS (SELECT *, max(attempt) FILTER (WHERE attempt * weight <= top) OVER () AS level FROM tried),
targets AS (
  SELECT *, coalesce(least(top, level * weight), top) AS target FROM levelled),
quotas AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM targets),
placed AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY shuffle, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto FROM sized)
SELECT p.doc_id, p.size, q.source_size, q.target,
       CASE WHEN p.size = 0 THEN 0 ELSE (q.quota // q.source_size) * p.size
            + greatest(0, least(p.upto, q.quota % q.source_size) - (p.upto - p.size)) END::BIGINT AS taken
FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source"""
