"""Fusion: the 13-feature table, the forest's answer and contextual features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import cues, text

_PARTS = {
    "rule": ["rule_score", "rule_polarity"],
    "sentiment": ["sentiment_score", "sentiment_confidence"],
    "absa": ["num_pos_aspects", "num_neg_aspects", "avg_aspect_score", "avg_aspect_confidence"],
    "emotion": ["emotion_score", "emotion_confidence", "emotion_distribution"],
    "sarcasm": ["sarcasm_score", "sarcasm_confidence"],
}


def fusion_features(
    reviews: DataFrame, rule: DataFrame, sentiment: DataFrame, absa: DataFrame, emotion: DataFrame, sarcasm: DataFrame
) -> DataFrame:
    """13 ordered features per review; a missing value is 0.0.

    Each signal table has at most one row per review and all joins use review_id, so the
    tables are co-partitioned; the text takes no part. A signal need not hold every review:
    what is absent gets its default here, so it needs no join with the reviews before. Scores
    of a blank text don't count as sentiment.
    """
    signals = {
        "rule": rule,
        "sentiment": sentiment.withColumnRenamed("confidence", "sentiment_confidence"),
        "absa": absa,
        "emotion": emotion,
        "sarcasm": sarcasm,
    }
    blank = text.is_blank("text") if "text" in reviews.columns else F.lit(False)
    out = reviews.select("review_id", blank.alias("_blank"))
    for name, table in signals.items():
        out = out.join(table.select("review_id", *_PARTS[name]), "review_id", "left")

    def feature(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.coalesce(F.when(~F.col("_blank"), value) if name in _PARTS["sentiment"] else value, F.lit(0.0)).alias(name)

    return out.select("review_id", *[feature(f) for f in schemas.FEATURES])


def fuse(features: DataFrame, model: PipelineModel, classes: list[str]) -> DataFrame:
    """Class of the largest probability (the first on a tie) and that probability."""
    probs = vector_to_array("probability")
    names = F.array(*[F.lit(c) for c in classes])
    scored = model.transform(features).withColumn("_probs", probs)
    best = F.array_max("_probs")
    return scored.select(
        *features.columns,
        F.element_at(names, F.array_position("_probs", best).cast("int")).alias("fused_label"),
        best.alias("fused_confidence"),
    )


def fuse_without_model(features: DataFrame) -> DataFrame:
    return features.select(
        "*", F.lit("neutral").alias("fused_label"), F.lit(0.0).alias("fused_confidence")
    )


def hidden_sentiment(reviews: DataFrame, **options) -> DataFrame:
    return reviews.select("review_id", cues.hidden_sentiment(F.col("text"), **options).alias("hidden_sentiment"))


def sarcastic_context(reviews: DataFrame, **options) -> DataFrame:
    return reviews.select("review_id", cues.sarcastic_context(F.col("text"), **options).alias("sarcasm_context_score"))


def aspect_balance(signals: DataFrame) -> DataFrame:
    balance = cues.aspect_balance(F.col("num_pos_aspects"), F.col("num_neg_aspects"))
    return signals.withColumn("aspect_balance", balance)


def contradiction(reviews: DataFrame, **options) -> DataFrame:
    return reviews.select("review_id", cues.contradiction(F.col("text"), **options).alias("contradiction_score"))


def advanced_features(signals: DataFrame) -> DataFrame:
    """Add the contextual features to signals(…, text, num_pos_aspects, num_neg_aspects)."""
    body = F.col("text")
    return signals.withColumns(
        {
            "hidden_sentiment": cues.hidden_sentiment(body),
            "sarcasm_context_score": cues.sarcastic_context(body),
            "contradiction_score": cues.contradiction(body),
            "aspect_balance": cues.aspect_balance(F.col("num_pos_aspects"), F.col("num_neg_aspects")),
        }
    )
