"""Small helpers of the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Word patterns of the result contracts (fixed values).
BLANK_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

BLANK_WORDS = re.compile(BLANK_WORD)
ALNUM_WORDS = re.compile(ALNUM_WORD)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """A-Z to a-z, all other characters as they are: bytes know no other letters."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 1 after division by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and where each text starts (one entry more than
    there are texts)."""
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(data, np.uint32), starts


def slices(frame: pd.DataFrame, column: str, chars: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Cut a batch into runs of rows that hold about ``chars`` characters, so that work arrays stay
    small whatever the text lengths are."""
    if not len(frame):
        return
    total = frame[column].str.len().fillna(0).to_numpy().cumsum()
    for _, part in frame.groupby((total // chars).astype(np.int64), sort=False):
        yield part


_BASE = 0x9E3779B97F4A7C55
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them; kept in the worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS


class SpanHashes:
    """64-bit hashes of any spans of an array of symbols, from one running sum.

    A span's hash depends on its symbols and length only, not on where it stands or what surrounds it."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        values = symbols.astype(np.uint64)
        values += np.uint64(1)
        values *= _powers(len(symbols) + 1)[0][:len(symbols)]
        np.cumsum(values, out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self.sums[start + length] - self.sums[start]
        out *= _powers(len(self.sums))[1][start]
        return mixed(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mixed(values: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit values, in place."""
    values ^= values >> np.uint64(32)
    values *= np.uint64(0x9FB21C651E98DF25)
    values ^= values >> np.uint64(29)
    return values


_BLANK_BYTE = np.zeros(256, bool)
_BLANK_BYTE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def blank_word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between blanks of all texts, A-Z lower-cased, and where each text's words
    start (one entry more than there are texts)."""
    data = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in data], out=starts[1:])
    symbols = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    edge = np.diff(_BLANK_BYTE[symbols].view(np.int8), prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return SpanHashes(symbols).of(begin, end - begin), np.searchsorted(begin, starts)
