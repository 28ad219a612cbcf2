"""The fixed values that the SQL twins share with the operators: a change of any of them must be meant."""

import hashlib

import pytest

from setledger.functions import vocabulary as V
from setledger.operators import rules

DIGESTS = {
    "vocabulary.UPPER_COMPOUND": "c766d3902235",
    "vocabulary.LOWER_COMPOUND": "425f24b2a9d7",
    "vocabulary.ISOLATION": "267171db52d4",
    "vocabulary.BODYWEIGHT": "1a4ed5b6ef65",
    "vocabulary.MODEL_GROUPS": "708f0fd828cf",
    "vocabulary.LIFT_ALIASES": "4a7005a7bac2",
    "vocabulary.PREDICTION_MARKERS": "03e832277406",
    "vocabulary.EXPLANATORY_PHRASES": "a027692945e5",
    "vocabulary.LOW_VALUE_MARKERS": "adaa86544020",
    "vocabulary.TRUSTED_SITES": "ac81b7756a99",
    "vocabulary.LOW_VALUE_WINDOW": "983bd614bb5a",
    "vocabulary.TITLE_WEIGHT": "e6743df815da",
    "vocabulary.EXPLANATORY_BONUS": "0602d7c813c1",
    "vocabulary.TRUSTED_BONUS": "773a15ec53a8",
    "vocabulary.LOW_VALUE_PENALTY": "36819111cffb",
    "vocabulary.BLOCK_TOKENS": "0ef96faa8650",
    "vocabulary.TRANSCRIPT_BLOCK_PHRASES": "758ac8c16ed8",
    "vocabulary.INTERNAL_ERROR_MARKERS": "9fdf040ca309",
    "vocabulary.CHUNK_WORDS": "7b69759630f8",
    "vocabulary.CHUNK_OVERLAP": "d59eced1ded0",
    "vocabulary.TOP_K": "4e07408562be",
    "vocabulary.OVERFETCH": "ef2d127de37b",
    "vocabulary.MIN_CANDIDATES": "f5ca38f748a1",
    "vocabulary.EXCERPT_CHARS": "deeeb5df3f2c",
    "vocabulary.CHAT_WINDOW": "2c624232cdd2",
    "vocabulary.DAILY_PROMPTS": "624b60c58c9d",
    "vocabulary.LEARNED_MODEL_MIN_ROWS": "0604cd3138fe",
    "vocabulary.TRAIN_RATIO": "1e9d7c27c8bb",
    "vocabulary.MIN_GROUP_ROWS": "4a44dc153642",
    "vocabulary.HISTORY_WINDOW": "4e07408562be",
    "vocabulary.EXCERPTS_HEADING": "eb243bd0dfa9",
    "vocabulary.HISTORY_HEADING": "eb3f2c302b1a",
    "vocabulary.PROFILE_HEADING": "2ac171a6215f",
    "vocabulary.PREDICTION_HEADING": "ef9cb7c748e1",
    "vocabulary.NO_EXCERPTS": "b0b482103547",
    "vocabulary.NO_HISTORY": "e0efdfa804c1",
    "vocabulary.NO_PROFILE": "f7163771168b",
    "vocabulary.EMPTY_PROFILE": "3e9b7d301827",
    "vocabulary.NOT_ASKED": "951accbdfb7d",
    "vocabulary.NO_TARGET": "fbb53bd02569",
    "vocabulary.UNAVAILABLE": "86ef2f3bd084",
    "vocabulary.INDEX_MISSING": "21561da25551",
    "vocabulary.LEARNED_NAME": "d0f1fcee6f57",
    "vocabulary.RULE_NAME": "da1ee4bad47a",
    "vocabulary.PROFILE_LABELS": "2ce7e9c94c00",
    "rules.MODEL_TYPE": "29c25b423066",
    "rules.EXPORT_COLUMNS": "f140640b2d4c",
    "rules.STEPS": "dc0e3c0bb0ed",
    "rules.PLAIN_STEP": "b8736b999909",
    "rules.STANDARD": "d42186a18ec6",
    "rules.RIR_NONE": "df93b71f937a",
    "rules.RIR_ONE": "c7d6cf10a868",
    "rules.RIR_MANY": "5d0979f598cf",
    "rules.RPE_MAX": "4afe8b71e3b8",
    "rules.RPE_HARD": "a40dd6161ff6",
    "rules.RPE_EASY": "d87c956e22f7",
    "rules.LOW_REP": "9e2a50766afb",
    "rules.HIGH_REP": "2765d31d21ee",
    "rules.NO_EFFORT": "261f3b5a9a71",
    "rules.UNLOADED_FACTORS": "232dfcea6d6e",
    "rules.UNLOADED_REASON": "94d191b439f6",
    "rules.OUTCOMES": "824b43b99ded",
}


def digest(value):
    return hashlib.sha256(repr(value).encode()).hexdigest()[:12]


def values():
    for module in (V, rules):
        for name, value in vars(module).items():
            if name.isupper() and isinstance(value, (str, int, float, list, tuple, dict)):
                yield f"{module.__name__.rsplit('.', 1)[-1]}.{name}", value


@pytest.mark.parametrize("name, value", list(values()))
def test_value(name, value):
    assert digest(value) == DIGESTS[name]


def test_no_value_left():
    assert set(DIGESTS) == {name for name, _ in values()}
