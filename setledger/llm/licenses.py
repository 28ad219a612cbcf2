"""License scans: ordered signature rules behind a keyword prefilter, with containment suppression.

A rule is a regular expression over the lower-cased (A-Z) text, its label, a priority, a confidence and
the literal keywords without which it cannot match. One automaton pass over a text finds the keywords;
only rules with all their keywords present are run. Keywords are single words, and the words of a name or
notice may be wrapped over lines, behind comment marks. A citation ("licensed under ...") of a family has a
priority and a confidence of its own, but no label that the bare name lacks. A detection that lies inside the interval of a
better one (higher priority, then longer, then earlier rule) is suppressed. Base detections always stay.

Defined results: null is the empty text; repeated rows each get their own result; a text without a
detection has empty label lists, no first and last word and score 0; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from setledger.llm.common import ALNUM_WORDS, lower_ascii

_LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Between two words of a name or notice: blanks, or a line break with the comment marks around it.
_WRAP = (r"(?:[^\S\r\n]*+(?:[*#/;%!|]++|-->)?+[^\S\r\n]*+[\r\n]\s*+(?:(?:<!--|[*#/;%!|>\"'-]++|(?:dnl|rem)\b)\s*+)*+"
         r"|[^\S\r\n]++)")

#: Base phrases and their labels (fixed values of the contract).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families: label, literal that must occur, name as it is written in notices.
FAMILIES = [
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e,? (?:version )?1\.1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e(?:,? (?:version|v\.?) ?2(?:\.0)?)?"),
    ("mit", "mit", r"mit (?:public )?licen[sc]e"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("0bsd", "bsd", r"(?:zero|0)[- ]clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", r"(?:(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd|bsd[- ]2[- ]clause)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd|bsd[- ]3[- ]clause)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:(?:original|4[- ]clause|four[- ]clause) bsd|bsd[- ]4[- ]clause)(?: licen[sc]e)?"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e,? (?:version|v\.?) ?1(?:\.0)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e,? (?:version|v\.?) ?2(?:\.0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e,? (?:version|v\.?) ?3(?:\.0)?"),
    ("lgpl-2.0", "library general public", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl-2.1", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e,? (?:version|v\.?) ?2\.1"),
    ("lgpl-3.0", "lesser general public", r"(?:gnu )?lesser general public licen[sc]e(?:,? (?:version|v\.?) ?3(?:\.0)?)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?:,? (?:version|v\.?) ?3(?:\.0)?)?"),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?:,? (?:version|v\.?) ?1\.[1-3])?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e,? (?:version|v\.?) ?1\.1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?:,? (?:version|v\.?) ?2(?:\.0)?)?"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e,? (?:version|v\.?) ?1\.0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?:,? (?:version|v\.?) ?2\.0)?"),
    ("edl-1.0", "eclipse", r"eclipse distribution licen[sc]e"),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?:,? (?:version|v\.?) ?1\.0)?"),
    ("cpl-1.0", "common public", r"common public licen[sc]e"),
    ("ipl-1.0", "ibm", r"ibm public licen[sc]e"),
    ("eupl-1.2", "european union", r"european union public licen[sc]e"),
    ("osl-3.0", "open software", r"open software licen[sc]e"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e"),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e,? (?:version )?1\.0"),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?:,? (?:version )?2\.0)?"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?:,? (?:version )?1\.0)?"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?:,? (?:version )?1\.1)?"),
    ("sspl-1.0", "server side", r"server side public licen[sc]e"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?:,? (?:version )?2\.0)?"),
    ("psf-2.0", "python software", r"python software foundation licen[sc]e"),
    ("php-3.01", "php", r"php licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[sc]e"),
    ("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database licen[sc]e"),
    ("pddl-1.0", "public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]e"),
    ("cc0-1.0", "cc0", r"cc0(?: 1\.0)?(?: universal)?"),
    ("cc-by", "cc", r"cc[- ]by(?![- ](?:sa|nc|nd))(?:[- ]\d\.\d)?"),
    ("cc-by-sa", "cc", r"cc[- ]by[- ]sa(?:[- ]\d\.\d)?"),
    ("cc-by-nd", "cc", r"cc[- ]by[- ]nd(?:[- ]\d\.\d)?"),
    ("cc-by-nc", "cc", r"cc[- ]by[- ]nc(?![- ](?:sa|nd))(?:[- ]\d\.\d)?"),
    ("cc-by-nc-sa", "cc", r"cc[- ]by[- ]nc[- ]sa(?:[- ]\d\.\d)?"),
    ("cc-by-nc-nd", "cc", r"cc[- ]by[- ]nc[- ]nd(?:[- ]\d\.\d)?"),
    ("cc-by", "creative commons", r"creative commons attribution(?![- ](?:share|non|no))(?: \d\.\d)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution[- ]share[- ]?alike(?: \d\.\d)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution[- ]non[- ]?commercial(?![- ](?:share|no))(?: \d\.\d)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike(?: \d\.\d)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution[- ]no[- ]?deriv(?:s|atives)(?: \d\.\d)?"),
]

#: How a family is cited: template around the name, further keyword, priority, confidence.
TEMPLATES = [
    (r"licen[sc]ed under (?:the )?{name}", "under", 30, 0.95),
    (r"(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{name}", "under", 28, 0.9),
    (r"(?:subject to|in accordance with|according to) (?:the )?(?:terms of (?:the )?)?{name}", "to", 26, 0.8),
    (r"{name}", "", 10, 0.6),
]

#: Notices that are no citation of a family: label, keywords, expression, priority, confidence.
NOTICES = [
    ("mit", ("permission is hereby granted",), r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 40, 0.99),
    ("bsd", ("redistribution and use",), r"redistribution and use in source and binary forms,? with or without modification", 40, 0.95),
    ("isc", ("permission to use, copy, modify",), r"permission to use, copy, modify,? and/?(?:or)? distribute this software", 40, 0.95),
    ("zlib", ("as-is", "implied"), r"provided 'as-is', without any express or implied warranty", 35, 0.8),
    ("gpl", ("free software foundation",), r"as published by the free software foundation", 35, 0.9),
    ("apache-2.0", ("apache.org/licenses",), r"apache\.org/licenses/license-2\.0", 40, 0.95),
    ("gpl", ("gnu.org/licenses",), r"gnu\.org/licenses/(?:old-licenses/)?(?:a|l)?gpl", 40, 0.9),
    ("mpl-2.0", ("mozilla.org/mpl",), r"mozilla\.org/mpl/2\.0", 40, 0.95),
    ("cc", ("creativecommons.org/licenses",), r"creativecommons\.org/licenses/[a-z-]+/\d\.\d", 40, 0.95),
    ("cc0-1.0", ("creativecommons.org/publicdomain",), r"creativecommons\.org/publicdomain/zero", 40, 0.95),
    ("public-domain", ("public domain",), r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain", 20, 0.7),
    ("proprietary", ("proprietary",), r"proprietary and confidential", 20, 0.7),
    ("proprietary", ("written permission",), r"without (?:the )?(?:prior |express )*written permission", 15, 0.5),
    ("copyright", ("copyright",), r"copyright (?:\(c\) |© )?\d{4}", 5, 0.4),
    ("copyright", ("©",), r"© ?\d{4}", 5, 0.4),
]


class Rule(NamedTuple):
    number: int
    label: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float
    base: bool


class Detection(NamedTuple):
    label: str
    rule: int
    base: bool
    confidence: float
    start: int
    end: int
    word: int


def wrapped(pattern: str) -> str:
    """The expression with every blank, also that of ``[- ]``, as a gap that may hold a line break."""
    return pattern.replace("[- ]", "(?:- ?| )").replace(" ", _WRAP)


def single_words(keywords: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(word for key in keywords for word in key.split()))


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, notices, identifiers, then families by template. Each one begins and ends
    at the edge of a word, so that no detection cuts a word in two."""
    edge, end = f"(?<!{_LETTER})", f"(?!{_LETTER})"
    made = [(label, tuple(phrase.split()), edge + _GAP.join(phrase.split()) + end, 50, 0.9, True)
            for phrase, label in BASE.items()]
    made += [(label, single_words(keys), edge + wrapped(pattern) + end, priority, sure, False)
             for label, keys, pattern, priority, sure in NOTICES]
    for label in dict.fromkeys(f[0] for f in FAMILIES):
        made.append((label, ("spdx", label.split("-")[0]),
                     edge + rf"spdx-license-identifier:\s*{re.escape(label)}(?:-\d\.\d)?(?:-only|-or-later)?{end}", 45, 0.99, False))
    for around, key, priority, sure in TEMPLATES:
        for label, literal, name in FAMILIES:
            always = re.sub(r"\(\?:[^()]*\)\?", "", name)
            keys = (literal, key, "licen" if "licen" in always else "")
            made.append((label, single_words(keys), edge + wrapped(around.format(name=name)) + end, priority, sure, False))
    return tuple(Rule(i, label, keys, re.compile(pattern), priority, sure, base)
                 for i, (label, keys, pattern, priority, sure, base) in enumerate(made))


@lru_cache(maxsize=1)
def _gate() -> ahocorasick.Automaton:
    """Keywords of four letters and more; shorter ones are frequent inside words and are looked up only
    for rules whose longer keywords are there."""
    automaton = ahocorasick.Automaton()
    for rule in rules():
        for word in rule.keywords:
            if len(word) >= 4:
                automaton.add_word(word, word)
    automaton.make_automaton()
    return automaton


@lru_cache(maxsize=1)
def _by_keyword() -> dict[str, list[tuple[Rule, frozenset[str], tuple[str, ...]]]]:
    """Rules under the first of their long keywords (the empty string if they have none), with all long
    and all short ones."""
    out: dict[str, list] = {}
    for rule in rules():
        long = [w for w in rule.keywords if len(w) >= 4]
        out.setdefault(long[0] if long else "", []).append(
            (rule, frozenset(long), tuple(w for w in rule.keywords if len(w) < 4)))
    return out


def unsuppressed(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Without detections that lie in the interval of a better one; base detections stay."""
    starts: list[int] = []  # kept intervals of which none holds another, so ends grow with starts
    ends: list[int] = []
    kept = []
    for rule, start, end in sorted(found, key=lambda f: (-f[0].priority, f[1] - f[2], f[1], f[0].number)):
        at = bisect_right(starts, start)
        inside = at > 0 and ends[at - 1] >= end
        if not inside or rule.base:
            kept.append((rule, start, end))
        if not inside:
            first = at - 1 if at and starts[at - 1] == start else at
            last = first
            while last < len(starts) and ends[last] <= end:
                last += 1
            starts[first:last], ends[first:last] = [start], [end]
    return sorted(kept, key=lambda f: (f[1], f[2], f[0].number))


def detect(text: str | None) -> tuple[int, list[Detection]]:
    """Number of words, and the detections in the order of the text."""
    lowered = lower_ascii(text or "")
    keys = {word for _, word in _gate().iter(lowered)}
    found = [(rule, m.start(), m.end()) for key in ("", *keys) for rule, long, short in _by_keyword().get(key, ())
             if keys >= long and all(word in lowered for word in short) for m in rule.pattern.finditer(lowered)]
    out, at, words = [], 0, 0
    for rule, start, end in unsuppressed(found):
        words += len(ALNUM_WORDS.findall(lowered, at, start))
        at = start
        out.append(Detection(rule.label, rule.number, rule.base, rule.confidence, start, end, words))
    return words + len(ALNUM_WORDS.findall(lowered, at)), out


DETECTIONS = ("array<struct<label:string,rule:int,base:boolean,confidence:double,start:long,end:long,word:long>>")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the detections of every text."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [detect(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_words": [n for n, _ in found],
                                "detections": [[d._asdict() for d in ds] for _, ds in found]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(scan, f"doc_id {kind}, n_words long, detections {DETECTIONS}")


def license_report(docs: DataFrame) -> DataFrame:
    """Counts, places and labels per document. The score is the chance that one detection at least is
    right, taking the rules' confidences as independent, one rule counted once."""
    scanned = scan_licenses(docs).withColumn("base", F.filter("detections", lambda d: d["base"]))
    labels = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda d: d["label"]))), ",")
    doubt = F.aggregate(F.array_distinct(F.transform("detections", lambda d: F.struct(d["rule"], d["confidence"]))),
                        F.lit(1.0), lambda rest, d: rest * (1.0 - d["confidence"]))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["word"])).alias("first_word"),
        F.array_max(F.transform("base", lambda d: d["word"])).alias("last_word"),
        labels("base").alias("base_labels"), labels("detections").alias("labels"), F.round(1.0 - doubt, 6).alias("score"))
