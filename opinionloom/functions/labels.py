"""Label and score rules shared by the sentiment, aspect and sarcasm operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

POSITIVE = ["positive", "very_positive"]
NEGATIVE = ["negative", "very_negative"]

# Spellings that stand for one class.
SYNONYMS = {
    "positive": ["pos", "positive", "pos_sentiment"],
    "negative": ["neg", "negative", "neg_sentiment"],
    "neutral": ["neu", "neutral", "neu_sentiment"],
    "very_positive": ["very positive", "very_positive"],
    "very_negative": ["very negative", "very_negative"],
}


def has_label_prefix(label: Column) -> Column:
    return F.upper(label).startswith("LABEL_")


def class_index(label: Column) -> Column:
    """The class number of '3' or 'LABEL_3' in any case; NULL when there is none."""
    digits = F.regexp_extract(label, r"(?i)^(?:label_)?\s*([+-]?\d+)\s*$", 1)
    return digits.try_cast("int")


def canonical(label: Column) -> Column:
    low = text.strip(F.lower(label))
    chain = None
    for name, spellings in SYNONYMS.items():
        test = low.isin(spellings)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain.otherwise(low)


def sentiment_of(label: Column) -> Column:
    return F.when(label.isin(POSITIVE), 1).when(label.isin(NEGATIVE), -1).otherwise(0)


def label_of(sentiment: Column) -> Column:
    return F.when(sentiment == 1, "positive").when(sentiment == -1, "negative").otherwise("neutral")


def signed(direction: Column, confidence: Column) -> Column:
    """Confidence with the sign of `direction`; adding 0.0 turns -0.0 into 0.0."""
    return direction * confidence + F.lit(0.0)


def aspect_label(raw: Column) -> Column:
    """LABEL_0/1/2 or a name; anything unknown or empty is neutral."""
    low = F.lower(raw)
    known = F.when(low.isin("positive", "negative", "neutral"), low).otherwise("neutral")
    index = class_index(raw)
    numbered = F.when(index == 0, "negative").when(index == 2, "positive").otherwise("neutral")
    return F.when(raw.isNull(), "neutral").when(has_label_prefix(raw), numbered).otherwise(known)


def aspect_direction(label: Column) -> Column:
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)


def rule_label(polarity: Column, cutoff: float) -> Column:
    return F.when(polarity >= cutoff, "positive").when(polarity <= -cutoff, "negative").otherwise("neutral")


def rule_score(polarity: Column, cutoff: float) -> Column:
    return F.when(polarity >= cutoff, 1).when(polarity <= -cutoff, -1).otherwise(0)
