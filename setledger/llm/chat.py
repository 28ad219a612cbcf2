"""Chat formatting with a grammar round trip.

Template of a turn::

    ### Assistant:\\n<text>\\n</turn>\\n

The roles system, user and assistant are written with a capital; any other role is written as a JSON
string. Inside a text, a control string (``###`` or ``</turn>``) that would be read as markup is escaped
by one backslash; one that already has backslashes gets one more. The parser takes away one backslash,
so it is the exact inverse. A text is escaped only if the plain rendering does not read back as itself:
render, parse, compare, escape, until the recovered turn is identical.

Every turn ends in the parser's start state, so turns are rendered and checked one by one, wherever they
are; a conversation is the concatenation of its turns. Only the digest of a conversation, which is a
running hash by its nature, reads turns in order: sorted in the shuffle and streamed with a constant
amount of state, never gathered.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text) with null first,
so ties and repeated rows have one order; rows with a null conv_id form one conversation; an empty table
gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Fixed values of the template.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
END = "\n</turn>\n"
TRAINED_ROLE = "assistant"

_NAMES = {shown: role for role, shown in ROLES.items()}
_HEADER = re.compile(r'### (System|User|Assistant|"(?:[^"\\]|\\.)*"):\n')
#: A run of three hashes or more is one control string, as a backslash in front of it covers all of it.
_CONTROL = re.compile(r"#{3,}|</turn>")
_ESCAPED = re.compile(r"\\(?=###|</turn>)")
_BARE_END = re.compile(r"(?<!\\)</turn>")
_BARE_MARK = re.compile(r"(?<![\\#])###")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def render(role: str, text: str) -> str:
    shown = ROLES.get(role) or json.dumps(role, ensure_ascii=False)
    return f"### {shown}:\n{text}{END}"


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """Turns as (role, text, start and end of the raw text in ``formatted``); None if it is no sequence
    of turns."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        end = head and _BARE_END.search(formatted, head.end())
        if not end or formatted[end.start() - 1:end.end() + 1] != END or end.start() <= head.end():
            return None
        raw = formatted[head.end():end.start() - 1]
        if _BARE_MARK.search(raw):
            return None
        shown = head.group(1)
        turns.append((_NAMES.get(shown) or json.loads(shown, strict=False), unescape(raw), head.end(), end.start() - 1))
        at = end.end() + 1
    return turns


def render_checked(role: str, text: str) -> str:
    """The rendering that reads back as exactly this turn."""
    for candidate in (text, escape(text)):
        out = render(role, candidate)
        back = parse(out)
        if back is not None and [t[:2] for t in back] == [(role, text)]:
            return out
    raise ValueError(f"a turn does not survive the round trip: {role!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``formatted``, one row per turn. Narrow: nothing is shuffled."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(formatted=[render_checked(r, t) for r, t in zip(batch["role"], batch["text"])])

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(work, schema + ", formatted string")


class _Reader:
    """What is known of a conversation after some of its turns."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.all, self.trained = hashlib.sha256(), hashlib.sha256()

    def take(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, _, _ in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == TRAINED_ROLE:
                self.loss += len(text)
                self.trained.update(text.encode())

    def row(self, conv_id) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss, self.trained.hexdigest(), self.chars


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: turns and text under the loss mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, reader, done = None, None, []
        for batch in batches:
            for conv_id, text in zip(batch["conv_id"], batch["formatted"]):
                key = None if pd.isna(conv_id) else conv_id
                if reader is None or key != current:
                    if reader is not None:
                        done.append(reader.row(current))
                    current, reader = key, _Reader()
                reader.take(text)
            if done:
                yield frame(done)
                done = []
        if reader is not None:
            yield frame([reader.row(current)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS)
        return out.astype({"conv_id": "Int64"}) if kind in ("bigint", "int") else out

    order = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return order.select("conv_id", "formatted").mapInPandas(
        work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
