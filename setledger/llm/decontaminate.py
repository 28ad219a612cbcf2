"""Benchmark decontamination by the q-gram lemma.

Items and texts are folded (letters lower-cased, each white space character a blank). An item is cut
into overlapping patterns of ``PATTERN`` and of ``PASSAGE`` characters, each less than its edits after the
last; a text leaks the item if it holds a pattern with at
most ``RATE`` of its length in edits. By the q-gram lemma such an occurrence shares at least
``m - q + 1 - k q`` q-grams with the pattern, and all of them lie on diagonals that differ by k at most.
So shared q-grams are counted in overlapping diagonal bands of width 2k; bands that meet the bound are
kept and aligned with a band of 2k + 1 cells, which decides.

The benchmark is taken in blocks of at most ``BLOCK_CHARS`` characters, each sent to all tasks and met
with every text; a larger benchmark means more passes, not a larger broadcast. Texts are never shuffled.

Defined results: a null or empty text or item has no leak; an item with fewer than q characters is too
short to be a passage and never matches; a verbatim part of ``PASSAGE`` characters, wherever it begins in
its item, leaks the item, a shorter part of a longer item need not; an item of less leaks as a whole only; repeated documents and repeated items each get their rows;
equal alignments go to the earliest place; empty tables give no leak; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from setledger.llm.common import code_points, slices

Q = 9
RATE = 0.08
PATTERN = 100
#: Smallest part of a longer item that counts.
PASSAGE = 80
BLOCK_CHARS = 2_000_000
_GATE_BITS = 22
_BASE = 1_000_003
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> str:
    """Lower case and blanks, one character for one."""
    if not text:
        return ""
    lowered = text.lower()
    if len(lowered) != len(text):
        lowered = "".join(l if len(l := c.lower()) == 1 else c for c in text)
    for blank in "\n\t\r\x0b\x0c\xa0":
        lowered = lowered.replace(blank, " ")
    return lowered


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q-gram that starts at each position."""
    one = points.astype(np.uint64)
    if len(one) < q:
        return one[:0]
    rolled, size, factor = one, 1, _BASE
    for bit in bin(q)[3:]:  # double the width, and add one where q's next bit is set
        doubled = rolled[:-size] * np.uint64(factor)
        doubled += rolled[size:]
        rolled, size, factor = doubled, 2 * size, factor * factor % 2**64
        if bit == "1":
            longer = rolled[:-1] * np.uint64(_BASE)
            longer += one[size:]
            rolled, size, factor = longer, size + 1, factor * _BASE % 2**64
    mixed = rolled * _MIX
    rolled >>= np.uint64(29)
    mixed ^= rolled
    return mixed


def patterns(length: int) -> list[tuple[int, int]]:
    """Overlapping stretches of an item, of both sizes, the last of each at its end."""
    out = set()
    for size in (PATTERN, PASSAGE):
        stride = int(RATE * size)
        starts = [*range(0, length - size, stride), length - size] if length > size else [0]
        out.update((s, min(s + size, length)) for s in starts if length)
    return sorted(out)


def budget(length: int, rate: float = RATE, q: int = Q) -> tuple[int, int]:
    """Edits allowed, and the shared q-grams that the lemma then demands (one at least)."""
    if length < q:
        return 0, 0
    edits = min(int(rate * length), (length - q) // q)
    return edits, length - q + 1 - edits * q


@lru_cache(maxsize=10_000)
def pattern_bounds(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of an item's patterns, and the shared q-grams that each demands; only those that
    can match."""
    rows = [(start, end, bound) for start, end in patterns(length) if (bound := budget(end - start)[1])]
    return tuple(np.array(rows, np.int64).reshape(-1, 3).T)


class ItemIndex:
    """q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q) -> None:
        self.items = [(item_id, fold(text)) for item_id, text in items]
        self.q = q
        points, starts = code_points([t for _, t in self.items])
        hashes, owner, place = [], [], []
        for i, (start, end) in enumerate(zip(starts[:-1], starts[1:])):
            own = gram_hashes(points[start:end], q)
            hashes.append(own)
            owner.append(np.full(len(own), i))
            place.append(np.arange(len(own)))
        empty = np.zeros(0, np.int64)
        hashes = np.concatenate(hashes or [empty.astype(np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owner = np.concatenate(owner or [empty])[order]
        self.place = np.concatenate(place or [empty])[order]
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[self.hashes >> np.uint64(64 - _GATE_BITS)] = True

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of the best alignment per text and item."""
        folded = [fold(t) for t in texts]
        points, starts = code_points(folded)
        own = gram_hashes(points, self.q)
        at = np.flatnonzero(self.gate[own >> np.uint64(64 - _GATE_BITS)])
        low = np.searchsorted(self.hashes, own[at], side="left")
        high = np.searchsorted(self.hashes, own[at], side="right")
        at, low, times = at[high > low], low[high > low], (high - low)[high > low]
        text = np.searchsorted(starts, at, side="right") - 1
        inside = at + self.q <= starts[text + 1]  # no q-gram across two texts
        at, low, times, text = at[inside], low[inside], times[inside], text[inside]
        entry = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        place = np.repeat(at - starts[text], times)
        text = np.repeat(text, times)
        item, offset = self.owner[entry], self.place[entry]
        return self._verified(folded, self._regions(text, item, place, offset))

    def _regions(self, text, item, place, offset) -> dict[tuple[int, int], set[tuple[int, int, int]]]:
        """(text, item) -> (pattern start, pattern end, first diagonal) of bands that meet the bound."""
        out: dict[tuple[int, int], set[tuple[int, int, int]]] = defaultdict(set)
        if not len(text):
            return out
        diagonal = place - offset
        width = max(1, 2 * int(RATE * PATTERN))
        least = min((int(pattern_bounds(n)[2].min()) for n in {len(t) for _, t in self.items} if n >= self.q), default=1)
        for shift in (0, width // 2):
            band = (diagonal + shift) // width
            key = np.lexsort((offset, band, item, text))
            t, i, b, o = text[key], item[key], band[key], offset[key]
            edge = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])])
            ends = np.r_[edge[1:], len(t)]
            enough = ends - edge >= least
            for first, last in zip(edge[enough], ends[enough]):
                places = np.unique(o[first:last])
                begin, end, bound = pattern_bounds(len(self.items[i[first]][1]))
                shared = np.searchsorted(places, end - self.q, side="right") - np.searchsorted(places, begin)
                for k in np.flatnonzero(shared >= bound):
                    out[int(t[first]), int(i[first])].add((int(begin[k]), int(end[k]), int(b[first]) * width - shift))
        return out

    def _verified(self, folded, regions) -> list[tuple[int, int, int, int, int]]:
        width = max(1, 2 * int(RATE * PATTERN))
        out = []
        for (text, item), found in sorted(regions.items()):
            best = None
            for start, end, diagonal in sorted(found):
                edits, _ = budget(end - start)
                pattern, low = self.items[item][1][start:end], max(0, start + diagonal - edits)
                exact = folded[text].find(pattern, low, max(0, start + diagonal + width + edits) + len(pattern))
                hit = (exact, exact + len(pattern), 0) if exact >= 0 else banded_alignment(
                    pattern, folded[text], start + diagonal, width, edits)
                if hit and (best is None or (hit[2], hit[0]) < (best[2], best[0])):
                    best = hit
                if best and best[2] == 0:
                    break
            if best:
                out.append((text, item, *best))
        return out


def banded_alignment(pattern: str, text: str, first: int, width: int, edits: int) -> tuple[int, int, int] | None:
    """Best place of ``pattern`` in ``text`` that begins at ``first .. first + width`` and drifts by
    ``edits`` at most: (start, end, distance), or None beyond ``edits``. Cells outside the band are not
    visited."""
    low, cells = first - edits, width + 2 * edits + 1
    worst = edits + 1
    # cost[j]: distance of the pattern's prefix to the text that ends at diagonal low + j; begin[j]: where it starts
    cost = [0 if 0 <= low + j <= len(text) else worst for j in range(cells)]
    begin = [low + j for j in range(cells)]
    for row, char in enumerate(pattern, 1):
        new, new_begin = [worst] * cells, begin[:]
        for j in range(cells):
            end = low + j + row
            if not 0 <= end <= len(text):
                continue
            value, start = worst, begin[j]
            if end >= 1 and cost[j] < worst:
                value, start = cost[j] + (text[end - 1] != char), begin[j]
            if j + 1 < cells and cost[j + 1] + 1 < value:
                value, start = cost[j + 1] + 1, begin[j + 1]
            if j and new[j - 1] + 1 < value:
                value, start = new[j - 1] + 1, new_begin[j - 1]
            new[j], new_begin[j] = min(value, worst), start
        cost, begin = new, new_begin
        if min(cost) >= worst:
            return None
    value, start, j = min((c, begin[j], j) for j, c in enumerate(cost))
    return (start, low + j + len(pattern), value) if value <= edits else None


def benchmark_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``chars`` characters; one block at a time is on the driver."""
    items = benchmark.filter(F.length("text") > 0).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // chars)
    for block in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block) if count > 1 else items
        found = rows.toPandas()
        yield sorted(zip(found["item_id"].tolist(), found["text"]), key=lambda r: (r[1], str(r[0])))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text) and edits, one row per leaked item."""
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, start long, end long, edits int"

    def search(shared):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(shared.value)
            ids = np.array([i for i, _ in shared.value], object)
            for batch in batches:
                for part in slices(batch, "text", 2_000_000):
                    found = index.leaks(part["text"].tolist())
                    if found:
                        rows = np.array(found, np.int64)
                        yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[rows[:, 0]], "item_id": ids[rows[:, 1]],
                                            "start": rows[:, 2], "end": rows[:, 3], "edits": rows[:, 4].astype(np.int32)})
        return work

    texts = docs.select("doc_id", "text")
    found = [texts.mapInPandas(search(context.broadcast(block)), schema) for block in benchmark_blocks(benchmark)]
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that leak an item, all columns kept. The decision is taken where
    the text is read: nothing is shuffled. Further blocks of a large benchmark filter one after another."""
    context = docs.sparkSession.sparkContext

    def keep(shared):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(shared.value)
            for batch in batches:
                for part in slices(batch, "text", 2_000_000):
                    leaking = {row[0] for row in index.leaks(part["text"].tolist())}
                    yield part[[i not in leaking for i in range(len(part))]]
        return work

    for block in benchmark_blocks(benchmark):
        docs = docs.mapInPandas(keep(context.broadcast(block)), docs.schema)
    return docs
