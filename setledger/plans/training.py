"""Training-log compositions: raw sets to labelled, split, predicted and evaluated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from setledger.functions.vocabulary import TRAIN_RATIO
from setledger.operators.evaluation import error_columns
from setledger.operators.labels import chronological_split, next_weight
from setledger.operators.rules import predict_by_rule
from setledger.operators.sessions import SESSION, collapse_sessions, valid_sets
from setledger.session import pin


def supervised_rows(sets: DataFrame, users: Sequence[str] = ()) -> DataFrame:
    """Sessions of typed sets with their next weight.

    Sessions are stored once: the steps after them look at the rows more than once, and the raw
    sets must not be read again for each of those looks.
    """
    sessions = pin(collapse_sessions(valid_sets(sets), [*users, *SESSION]))
    return next_weight(sessions, [*users, "exercise"])


def split_rows(sets: DataFrame, ratio: float = TRAIN_RATIO, users: Sequence[str] = ()) -> DataFrame:
    """Supervised rows, stored, then tagged train and test."""
    return chronological_split(pin(supervised_rows(sets, users)), ratio,
                               ["logged_at", "date", "exercise", *users])


def scored_rule_predictions(split: DataFrame, part: str = "test") -> DataFrame:
    """Rule predictions of one part of a split, with error columns."""
    return error_columns(predict_by_rule(split.filter(split["dataset"] == part)))
