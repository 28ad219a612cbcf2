"""Stored text documents to overlapping word chunks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from setledger.functions.text import strip, unify_breaks, words
from setledger.functions.vocabulary import CHUNK_OVERLAP, CHUNK_WORDS
from setledger.operators.ordering import ranked
from setledger.schemas import DOCUMENT_FIELDS
from setledger.session import pin

ERROR_PREFIX = "[ERROR]"
_HEADER_LINES = len(DOCUMENT_FIELDS) + 1


def keep_computed(df: DataFrame, name: str, value: Column, test: Callable[[Column], Column]) -> DataFrame:
    """``df`` with column ``name`` and only the rows whose value passes ``test``.

    A plain filter on a computed column is pushed below the projection and computes the value a
    second time; on long texts that is most of the cost. Exploding a filtered one-element array
    computes it once.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.filter(F.array(value), test)).alias(name))


def usable_text(df: DataFrame, column: str = "raw_text") -> DataFrame:
    """Stripped text, without empty documents and error placeholders."""
    return keep_computed(df, column, strip(F.col(column)), lambda t: (t != "") & ~t.startswith(ERROR_PREFIX))


def parse_header(df: DataFrame, column: str = "raw_text") -> DataFrame:
    """Split a document into its five header fields and its body.

    The header counts only when there are six lines and all five labels stand in order; line six
    is dropped unseen. Otherwise the whole text is the body, and the fields read before the first
    wrong line stay filled.
    """
    # six lines and the rest of the text as a seventh element
    split = F.split(unify_breaks(F.col(column)), "\n", _HEADER_LINES + 1)
    docs = usable_text(df, column).withColumn("_lines", split)
    good: Column = F.size("_lines") >= _HEADER_LINES
    fields = {}
    for i, name in enumerate(DOCUMENT_FIELDS):
        label = f"{name.upper()}:"
        line = F.get("_lines", F.lit(i))
        good = good & F.coalesce(line.startswith(label), F.lit(False))
        fields[name] = F.when(good, strip(F.substr(line, F.lit(len(label) + 1)))).otherwise("")
    rest = F.coalesce(F.get("_lines", F.lit(_HEADER_LINES)), F.lit(""))
    body = F.when(good, strip(rest)).otherwise(F.col(column))
    parsed = keep_computed(docs, "text", body, lambda t: t != "")
    return parsed.withColumns(fields).drop("_lines", column)


def document_record(text: Column, **fields: Column) -> Column:
    """The stored form of a document; null when there is no text worth storing."""
    header = [F.concat(F.lit(f"{n.upper()}: "), F.coalesce(fields[n], F.lit(""))) for n in DOCUMENT_FIELDS]
    worth = text.isNotNull() & (text != "") & ~text.startswith(ERROR_PREFIX)
    return F.when(worth, F.concat_ws("\n", *header, F.lit(""), text))


def chunk_count(n_words: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of a text of ``n_words`` words: the last one is the first that reaches the end."""
    step = max(1, size - overlap)
    return F.when(n_words == 0, 0).when(n_words <= size, 1).otherwise(F.ceil((n_words - size) / F.lit(step)).cast("int") + 1)


def chunk_words(df: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP,
                column: str = "text") -> DataFrame:
    """One row per chunk of ``size`` words; neighbours share ``overlap`` words.

    A row-wise expansion: no shuffle.
    """
    step = max(1, size - overlap)
    w = F.col("_words")
    count = chunk_count(F.size(w), size, overlap)
    starts = F.when(F.col("_count") > 0, F.sequence(F.lit(0), F.col("_count") - 1)).otherwise(
        F.array().cast("array<int>"))
    parts = F.transform(starts, lambda i: F.slice(w, i * step + 1, F.lit(size)))
    kept = [c for c in df.columns if c != column]
    return (df.withColumn("_words", words(F.col(column))).withColumn("_count", count)
            .select(*kept, F.posexplode(parts).alias("chunk_index", "_part"))
            .select(*kept, "chunk_index", F.size("_part").alias("n_words"),
                    F.array_join("_part", " ").alias(column)))


def chunk_numbers(docs: DataFrame, doc_order: Sequence[str] = ("doc_id",), size: int = CHUNK_WORDS,
                  overlap: int = CHUNK_OVERLAP, column: str = "text") -> DataFrame:
    """(doc_order, chunk_index, chunk_id, n_words) of every chunk; ``chunk_id`` runs from 0 over documents in order and
    chunks in order.

    The stable key is (document, chunk_index); this number is for exchange with position-based formats. All of
    it follows from the word counts: texts are read once, in place, and only keys and counts are stored,
    sorted and shuffled.
    """
    lengths = pin(docs.select(*doc_order, F.size(words(F.col(column))).alias("_total")))
    counts = lengths.withColumn("_chunks", chunk_count(F.col("_total"), size, overlap)).filter("_chunks > 0")
    placed = running_total(counts, doc_order, "_chunks", "_offset")
    index = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk_index")
    left = F.col("_total") - F.col("chunk_index") * max(1, size - overlap)
    return (placed.select(*doc_order, "_total", "_offset", index)
            .select(*doc_order, "chunk_index", (F.col("_offset") + F.col("chunk_index")).alias("chunk_id"),
                    F.least(F.lit(size), left).alias("n_words")))


def running_total(df: DataFrame, order: Sequence[str], amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over all earlier rows of the table in ``order``.

    Rows are numbered, cut into blocks of consecutive numbers, summed inside each block, and
    shifted by the total of the earlier blocks.
    """
    block = 100_000
    placed = (ranked(df, [], list(order), "_place")
              .withColumn("_block", F.floor((F.col("_place") - 1) / block)))
    totals = placed.groupBy("_block").agg(F.sum(amount).alias("_total"))
    # one row per block of the table
    earlier_blocks = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select("_block", F.coalesce(F.sum("_total").over(earlier_blocks), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("_block").orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    return (placed.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
            .join(shifts, "_block")
            .withColumn(name, F.col("_inside") + F.col("_shift"))
            .drop("_place", "_block", "_inside", "_shift"))


def index_stats(chunks: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    return chunks.agg(F.countDistinct(doc_key).alias("num_files"), F.count("*").alias("num_chunks"))
