"""Emotion scores: pool clauses, fill absent labels, total, spread and winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import resources
from .scoring import long_scores


def _known(emotions: Sequence[str]) -> list[str]:
    return [e.lower() for e in emotions]


def emotion_max_pool(clause_scores: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    """clause_scores(review_id, clause_idx, label, score) -> largest score per review and known label."""
    label = F.lower("label")
    return (
        clause_scores.select("review_id", label.alias("label"), "score")
        .where(F.col("label").isin(_known(emotions)))
        .groupBy("review_id", "label")
        .agg(F.max("score").alias("score"))
    )


def emotion_fill(reviews: DataFrame, clause_scores: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    """One row per review with a score column for every label, in label order; absent is 0.

    The maximum per label is taken straight from the clause rows, so one shuffle
    on review_id serves all labels.
    """
    return add_emotions(reviews.select("review_id"), clause_scores, emotions)


def pooled_emotions(clause_scores: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    """A score column for every label, of the reviews with scores."""
    known = _known(emotions)
    clause_scores = long_scores(clause_scores)
    label = F.lower("label")
    columns = [F.max(F.when(label == e, F.col("score"))).alias(e) for e in known]
    return clause_scores.groupBy("review_id").agg(*columns).fillna(0.0, subset=known)


def add_emotions(df: DataFrame, clause_scores: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    return df.join(pooled_emotions(clause_scores, emotions), "review_id", "left").fillna(0.0, subset=_known(emotions))


def emotion_rows(filled: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    """The long form (review_id, label_pos, label, score)."""
    pairs = F.array(*[F.struct(F.lit(e).alias("label"), F.col(e).alias("score")) for e in _known(emotions)])
    return filled.select("review_id", F.posexplode(pairs).alias("label_pos", "e")).select(
        "review_id", "label_pos", "e.label", "e.score"
    )


def total(emotions: Sequence[str] = resources.EMOTIONS) -> Column:
    return sum((F.col(e) for e in _known(emotions)[1:]), F.col(_known(emotions)[0]))


def entropy(emotions: Sequence[str] = resources.EMOTIONS, floor: float = resources.SIGNIFICANT_EMOTION) -> Column:
    """Normalised entropy of the scores above `floor`; 0 for fewer than two.

    With S the sum of the scores s, -sum(p ln p) equals ln S - sum(s ln s) / S.
    """
    scores = F.filter(F.array(*[F.col(e) for e in _known(emotions)]), lambda s: s > floor)
    s = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    s_ln_s = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x * F.ln(x))
    return F.when(F.size(scores) > 1, (F.ln(s) - s_ln_s / s) / F.ln(F.lit(float(len(emotions))))).otherwise(0.0)


def emotion_totals(filled: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    return filled.select(
        "review_id",
        total(emotions).alias("emotion_score"),
        (total(emotions) / F.lit(float(len(emotions)))).alias("emotion_confidence"),
    )


def emotion_entropy(filled: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    return filled.select("review_id", entropy(emotions).alias("emotion_distribution"))


def winner(emotions: Sequence[str] = resources.EMOTIONS) -> tuple[Column, Column]:
    """(label, score) of the largest score; the first label on a tie."""
    columns = [F.col(e) for e in _known(emotions)]
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    names = F.array(*[F.lit(e) for e in _known(emotions)])
    first = F.array_position(F.array(*columns), best)
    return F.element_at(names, first.cast("int")), best


def top_emotion(filled: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    if not emotions:
        return filled.select(
            "review_id", F.lit("neutral").alias("emotion_label"), F.lit(0.0).alias("top_emotion_score")
        )
    label, score = winner(emotions)
    return filled.select("review_id", label.alias("emotion_label"), score.alias("top_emotion_score"))


def emotion_signals(filled: DataFrame, emotions: Sequence[str] = resources.EMOTIONS) -> DataFrame:
    """All emotion outputs of a review in one projection."""
    label, score = winner(emotions)
    return filled.select(
        "*",
        total(emotions).alias("emotion_score"),
        (total(emotions) / F.lit(float(len(emotions)))).alias("emotion_confidence"),
        entropy(emotions).alias("emotion_distribution"),
        label.alias("emotion_label"),
        score.alias("top_emotion_score"),
    )
