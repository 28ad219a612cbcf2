"""Yes/no columns over fixed phrase lists."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from setledger.functions import vocabulary as V
from setledger.functions.text import contains_any, normalize_name


def is_prediction_question(text: Column) -> Column:
    return contains_any(F.lower(text), V.PREDICTION_MARKERS)


def prefers_explanatory(text: Column) -> Column:
    return contains_any(F.lower(text), V.EXPLANATORY_PHRASES)


def has_low_value_text(text: Column, window: int | None = None) -> Column:
    """Lower first, cut second: lower-casing can change the length."""
    lowered = F.lower(text)
    return contains_any(lowered if window is None else F.substring(lowered, 1, window),
                        V.LOW_VALUE_MARKERS)


def is_block_error(message: Column) -> Column:
    return F.coalesce(contains_any(F.lower(message), V.BLOCK_TOKENS), F.lit(False))


def is_transcript_block(message: Column) -> Column:
    return F.coalesce(contains_any(F.lower(message), V.TRANSCRIPT_BLOCK_PHRASES), F.lit(False))


def is_internal_error(message: Column) -> Column:
    return contains_any(message, V.INTERNAL_ERROR_MARKERS)


def trusted_site(website: Column) -> Column:
    return contains_any(F.lower(F.coalesce(website, F.lit(""))), V.TRUSTED_SITES)


def exercise_class(exercise: Column) -> Column:
    """Class that sets the weight step: lower, upper, isolation, bodyweight, other."""
    name = normalize_name(exercise)
    return (F.when(contains_any(name, V.LOWER_COMPOUND), "lower_compound")
            .when(contains_any(name, V.UPPER_COMPOUND), "upper_compound")
            .when(contains_any(name, V.ISOLATION), "isolation")
            .when(contains_any(name, V.BODYWEIGHT), "bodyweight")
            .otherwise("other"))


def model_group(exercise: Column) -> Column:
    """Group that picks the learned model: bodyweight is asked first here."""
    name = normalize_name(F.coalesce(exercise, F.lit("")))
    return (F.when(contains_any(name, V.BODYWEIGHT), "bodyweight")
            .when(contains_any(name, V.LOWER_COMPOUND), "lower_compound")
            .when(contains_any(name, V.UPPER_COMPOUND), "upper_compound")
            .when(contains_any(name, V.ISOLATION), "isolation")
            .otherwise("global"))


def matched_lifts(exercise: Column) -> Column:
    """Positions of the lifts whose alias occurs in the exercise name, in reporting order."""
    name = F.lower(exercise)
    hits = [F.when(contains_any(name, aliases), F.lit(i))
            for i, aliases in enumerate(V.LIFT_ALIASES.values())]
    return F.array_compact(F.array(*hits))
