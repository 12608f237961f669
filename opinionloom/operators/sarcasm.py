"""Sarcasm: best classifier label -> sarcastic flag and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

# Labels that mean sarcastic; every other label means not sarcastic.
SARCASTIC_LABELS = ["LABEL_1", "SARCASTIC"]


def _flags(label: Column, score: Column) -> dict[str, Column]:
    flag = F.coalesce(F.upper(text.strip(label)).isin(SARCASTIC_LABELS), F.lit(False))
    return {
        "sarcasm_label": F.when(flag, "sarcastic").otherwise("not_sarcastic"),
        "sarcasm_score": flag.cast("int"),
        "sarcasm_confidence": F.coalesce(score, F.lit(0.0)),
    }


def sarcasm_signals(best: DataFrame) -> DataFrame:
    """Label, flag and confidence of the reviews with scores: best(review_id, label, score)."""
    return best.select("review_id", *[c.alias(n) for n, c in _flags(F.col("label"), F.col("score")).items()])


def add_sarcasm(df: DataFrame, best: DataFrame) -> DataFrame:
    """Add label, flag and confidence from best(review_id, label, score); no score gives 0 / 0.0."""
    joined = df.join(best.select("review_id", F.col("label").alias("_label"), F.col("score").alias("_score")), "review_id", "left")
    return joined.withColumns(_flags(F.col("_label"), F.col("_score"))).drop("_label", "_score")


def sarcasm_result(reviews: DataFrame, best: DataFrame) -> DataFrame:
    """One row per review."""
    return add_sarcasm(reviews.select("review_id"), best)
