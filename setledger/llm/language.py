"""Language identification by cross-parsing.

For each language a suffix automaton is built from labelled text. A text is parsed greedily into the
longest phrases that occur in the language's sample; the language that needs the fewest phrases, each
counted at the cost of a pointer into its sample (log2 of the sample length), is predicted.

Symbols: letters are lower-cased by code point, everything else is a blank. The 200 most frequent
letters of the samples have symbols of their own, rarer ones share 50 by remainder, so no text is cut
out. Whole texts are parsed; for speed they are taken in stretches of at most 4,096 symbols that are
walked side by side, which adds at most one phrase per stretch to every language alike.

The samples are bounded: per language the ``rows`` labelled rows with the smallest hash, one window of
``window`` characters of each, about 40,000 characters together. Automata are built in the tasks, one
language at a time.

Defined results: null text or text without a letter is ``und`` with score 0; without training text every
text is ``und``; equal costs go to the smaller language name; repeated rows get equal results; other
columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from setledger.llm.common import code_points, held_out, slices
from setledger.session import pin

ROWS_PER_LANGUAGE = 100
WINDOW = 400
STRETCH = 4_096
OWN_SYMBOLS = 200
SHARED_SYMBOLS = 50
BLANK, FIRST_OWN = 0, 1
WIDTH = FIRST_OWN + OWN_SYMBOLS + SHARED_SYMBOLS


def training_samples(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, window: int = WINDOW) -> dict[str, str]:
    """language -> sample, of ``rows`` different texts per language, those with the smallest hashes; copies
    count once. Only hashes are shuffled to find them; each task sends on at most ``rows`` per language."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    key = F.xxhash64("text")
    ranked = learn.select("lang", key.alias("key")).distinct().withColumn(
        "rank", F.row_number().over(W.partitionBy("lang").orderBy("key"))).filter(F.col("rank") <= rows)
    start = F.pmod(key, F.greatest(F.length("text") - window, F.lit(0)) + 1) + 1
    cut = learn.select("lang", key.alias("key"), F.expr("text").substr(start.cast("int"), F.lit(window)).alias("part"))
    met = cut.join(pin(ranked), ["lang", "key"]).groupBy("lang", "rank").agg(F.min("part").alias("part"))
    found = met.toPandas().sort_values(["lang", "rank"])
    return {lang: "\n".join(part["part"]) for lang, part in found.groupby("lang")}


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter, and its lower case."""
    points = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
    is_letter = np.fromiter((p.isalpha() for p in points), bool, len(points))
    lower = np.fromiter((ord(l) if len(l := p.lower()) == 1 else ord(p) for p in points), np.uint32, len(points))
    return is_letter, lower


@lru_cache(maxsize=2)
def symbol_table(samples: tuple[tuple[str, str], ...]) -> np.ndarray:
    """Symbol of every code point."""
    is_letter, lower = _letters()
    seen: Counter[str] = Counter()
    for _, text in samples:
        seen.update(text)
    folded: Counter[int] = Counter()
    for char, n in seen.items():
        if is_letter[ord(char)]:
            folded[int(lower[ord(char)])] += n
    own = np.zeros(0x110000, np.uint8)
    for at, (point, _) in enumerate(sorted(folded.items(), key=lambda x: (-x[1], x[0]))[:OWN_SYMBOLS]):
        own[point] = FIRST_OWN + at
    shared = (FIRST_OWN + OWN_SYMBOLS + np.arange(0x110000) % SHARED_SYMBOLS).astype(np.uint8)
    table = np.where(own > 0, own, shared)[lower]
    table[~is_letter] = BLANK
    return table


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring; state 0 is the start."""
    after, link, length, last = [{}], [-1], [0], 0
    for symbol in symbols:
        new = len(after)
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        state = last
        while state >= 0 and symbol not in after[state]:
            after[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = after[state][symbol]
            if length[target] == length[state] + 1:
                link[new] = target
            else:
                twin = len(after)
                after.append(dict(after[target]))
                link.append(link[target])
                length.append(length[state] + 1)
                while state >= 0 and after[state].get(symbol) == target:
                    after[state][symbol] = twin
                    state = link[state]
                link[target] = link[new] = twin
        last = new
    return after


@lru_cache(maxsize=16)
def walk_table(samples: tuple[tuple[str, str], ...], language: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The automaton as one array: entry ``base + column`` leads to the next state's base, negative where
    a phrase ends before (or, for a symbol that the sample lacks, with) this symbol. Second, the columns
    of the symbols; third, the start's base."""
    symbols = symbol_table(samples)[code_points([dict(samples)[language]])[0]]
    used = np.unique(symbols)
    column = np.zeros(WIDTH, np.int32)
    column[used] = np.arange(1, len(used) + 1)  # column 0: symbols that the sample lacks
    width = len(used) + 1
    after = suffix_automaton(column[symbols].tolist())
    start = width  # the first row stays empty, so that no base is 0
    table = np.zeros((len(after) + 1, width), np.int32)
    table[:, 0] = -start
    for symbol, target in after[0].items():
        table[:, symbol] = -(target + 1) * width
    for state, out in enumerate(after):
        table[state + 1, list(out)] = [(t + 1) * width for t in out.values()]
    return table.ravel(), column, start


def phrases(stretches: np.ndarray, lengths: np.ndarray, walk: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Phrases of each stretch; ``stretches`` has one column per stretch, longest first."""
    table, column, start = walk
    state, count = np.full(len(lengths), start, np.int32), np.zeros(len(lengths), np.int64)
    alive = np.searchsorted(-lengths, -np.arange(1, len(stretches) + 1), side="right")
    for step, k in enumerate(alive):
        if not k:
            break
        went = table[state[:k] + column[stretches[step, :k]]]
        count[:k] += went < 0
        state[:k] = np.abs(went)
    return count + (state != start)


def parse_costs(texts: list[str], samples: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) bits, and whether a text has a letter."""
    points, starts = code_points(texts)
    symbols = symbol_table(samples)[points]
    # runs of blanks count as one
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK)
    offsets = np.concatenate([[0], np.cumsum(keep)])[starts]
    symbols = symbols[keep]
    letters = np.concatenate([[0], np.cumsum(symbols != BLANK)])
    has_letter = letters[offsets[1:]] > letters[offsets[:-1]]
    sizes = np.diff(offsets)
    parts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = offsets[owner] + nth * STRETCH
    length = np.minimum(STRETCH, offsets[owner + 1] - begin)
    order = np.argsort(-length, kind="stable")
    owner, begin, length = owner[order], begin[order], length[order]
    costs = np.zeros((len(texts), len(samples)))
    for first in range(0, len(owner), 2_000):
        own, at, n = (x[first:first + 2_000] for x in (owner, begin, length))
        grid = np.minimum(at[None, :] + np.arange(n[0])[:, None], len(symbols) - 1)
        block = symbols[grid]
        for k, (language, sample) in enumerate(samples):
            found = phrases(block, n, walk_table(samples, language))
            costs[:, k] += np.bincount(own, found * np.log2(len(sample) + 1.0), len(texts))
    return costs, has_letter


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """``docs`` with lang_pred and score: the share of the best language when each has weight
    ``2 ** (-bits per phrase-sized stretch)``; near 1 if the runner-up needs far more phrases."""
    languages = tuple(sorted(samples.items()))
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array([name for name, _ in known] + ["und"], object)
        for batch in batches:
            for part in slices(batch, "text", 4_000_000):
                texts = [t or "" for t in part["text"]]
                if not known:
                    yield part.assign(lang_pred="und", score=0.0)
                    continue
                costs, has_letter = parse_costs(texts, known)
                best = costs.argmin(axis=1)
                weight = np.exp2(-np.minimum(costs - costs.min(axis=1, keepdims=True), 60.0) / 4.0)
                score = np.where(has_letter, 1.0 / weight.sum(axis=1), 0.0)
                yield part.assign(lang_pred=names[np.where(has_letter, best, len(known))], score=np.round(score, 9))

    kept = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(work, schema + ", lang_pred string, score double")
