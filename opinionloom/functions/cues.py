"""Contextual features of a text: cue phrases, punctuation and balance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import resources


def mentions_any(text: Column, phrases: Sequence[str], regex: bool = False) -> Column:
    """True when the lower-cased text holds one of the phrases."""
    low = F.lower(text)
    tests = [low.rlike(p) if regex else low.contains(p) for p in phrases]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def hidden_sentiment(text: Column, phrases: Sequence[str] = resources.HIDDEN_NEGATIVE, regex: bool = False) -> Column:
    return F.when(mentions_any(text, phrases, regex), -0.6).otherwise(0.0)


def count_char(text: Column, char: str) -> Column:
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(char), F.lit(""))), F.lit(0))


def sarcastic_context(
    text: Column,
    cues: Sequence[str] = resources.SARCASM_CUES,
    questioned: Sequence[str] = resources.QUESTIONED_POSITIVES,
) -> Column:
    cue = F.when(mentions_any(text, cues), 0.6).otherwise(0.0)
    shout = F.when(count_char(text, "!") > 2, 0.3).otherwise(0.0)
    question = F.when(mentions_any(text, [p + "?" for p in questioned]), 0.4).otherwise(0.0)
    return F.least(F.lit(1.0), cue + shout + question)


def aspect_balance(pos: Column, neg: Column) -> Column:
    return F.when(pos + neg == 0, 0.0).otherwise(1.0 - F.abs(pos - neg) / F.nullif(pos + neg, F.lit(0)))


def contradiction(
    text: Column,
    positives: Sequence[str] = resources.CONTRADICTION_POSITIVES,
    contrasts: Sequence[str] = resources.CONTRADICTION_CONTRASTS,
) -> Column:
    both = mentions_any(text, positives) & mentions_any(text, contrasts)
    return both.cast("double")
