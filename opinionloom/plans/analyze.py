"""The whole analysis of a set of reviews as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import resources, schemas
from ..functions import labels, text
from ..functions.chosen import chosen_ids
from ..operators import aspects as absa
from ..operators import emotion, fusion, lexicon, sarcasm, scoring
from ..resources import Lexicon


@dataclass
class Scores:
    """Classifier scores from any distributed scorer; None means there is no such classifier.

    sentiment and sarcasm: (review_id, model, pos, label, score)
    aspects: (review_id, aspect, pos, label, score)
    emotions: (review_id, clause_idx, label, score)
    Each may hold one array `scores` per unit in place of pos, label and score: then the best
    class is found in the row, without a shuffle.
    """

    sentiment: DataFrame | None = None
    aspects: DataFrame | None = None
    emotions: DataFrame | None = None
    sarcasm: DataFrame | None = None

    def cut_to(self, reviews: DataFrame) -> Scores:
        """The scores of these reviews alone: what a delta or a micro-batch needs of tables that hold all reviews."""
        tables = [(f.name, getattr(self, f.name)) for f in fields(self)]
        if all(t is None for _, t in tables):
            return self
        ids = chosen_ids(reviews)
        return Scores(**{name: None if t is None else ids.rows_of(t) for name, t in tables})


@dataclass
class Settings:
    """lexicon and aspects may be tables (token, valence_milli, polarity_milli) and (aspect) of any size;
    modifiers are the boosters and negators of a lexicon table. pos maps lower-case words to ADJECTIVE or
    NOUN (see operators.shaping): with it only ADJ* NOUN+ spans can be aspects, without it every run of words can."""

    lexicon: Lexicon | DataFrame = field(default_factory=lambda: resources.DEFAULT_LEXICON)
    modifiers: Lexicon | None = None
    aspects: Sequence[str] | DataFrame = field(default_factory=lambda: resources.ASPECTS)
    pos: Mapping[str, int] | None = None
    emotions: Sequence[str] = field(default_factory=lambda: resources.EMOTIONS)
    sentiment_model: str = "siebert/sentiment-roberta-large-english"
    context_window: int = resources.CONTEXT_WINDOW
    label_map: DataFrame | None = None


@dataclass
class Analysis:
    """signals: one row per review with every output; details: one row per review and aspect."""

    signals: DataFrame
    details: DataFrame


def aspect_details(reviews: DataFrame, scores: DataFrame | None, settings: Settings) -> DataFrame:
    """Aspects of each non-blank review with context and label; no rows without a classifier."""
    usable = absa.add_aspect_arrays(reviews.where(~text.is_blank("text")), settings.aspects, settings.pos)
    context = absa.exploded_contexts(usable, settings.context_window)
    if scores is None:
        context = context.where(F.lit(False))
        return context.select(
            "review_id", "aspect", F.lit("neutral").alias("sentiment_label"), F.lit(0.0).alias("sentiment_score"),
            F.lit(0.0).alias("confidence"), "context_phrase",
        )
    rated = absa.aspect_sentiment(scores).drop("raw_label")
    return context.join(rated, ["review_id", "aspect"], "left").select(
        "review_id",
        "aspect",
        F.coalesce("sentiment_label", F.lit("neutral")).alias("sentiment_label"),
        F.coalesce("sentiment_score", F.lit(0.0)).alias("sentiment_score"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "context_phrase",
    )


def _add_sentiment(df: DataFrame, scores: DataFrame | None, settings: Settings) -> DataFrame:
    if scores is None:
        rated = df.withColumns({"sentiment": F.lit(0), "confidence": F.lit(0.0)})
    else:
        label_map = settings.label_map or scoring.catalog_label_map(df.sparkSession)
        chosen = scores.where(F.col("model") == settings.sentiment_model)
        # Grouped by review_id alone, so the result is already placed for the join.
        best = scoring.argmax_label(chosen, ("review_id",)).withColumn("model", F.lit(settings.sentiment_model))
        normalized = scoring.normalize_labels(best, label_map)
        rated = scoring.add_sentiment(df, normalized, settings.sentiment_model, F.col("_blank"))
    return scoring.signed_score(rated).withColumnRenamed("confidence", "sentiment_confidence")


def _add_emotion(df: DataFrame, scores: DataFrame | None, settings: Settings) -> DataFrame:
    if scores is None:
        filled = df.withColumns({e.lower(): F.lit(0.0) for e in settings.emotions})
    else:
        filled = emotion.add_emotions(df, scores, settings.emotions)
    return emotion.emotion_signals(filled, settings.emotions)


def _add_sarcasm(df: DataFrame, scores: DataFrame | None) -> DataFrame:
    if scores is None:
        none = {"sarcasm_label": F.lit("not_sarcastic"), "sarcasm_score": F.lit(0), "sarcasm_confidence": F.lit(0.0)}
        return df.withColumns(none)
    return sarcasm.add_sarcasm(df, scoring.argmax_label(scores, ("review_id",)))


def analyze_reviews(
    reviews: DataFrame,
    scores: Scores | None = None,
    settings: Settings | None = None,
    model: tuple[PipelineModel, list[str]] | None = None,
) -> Analysis:
    """All signals of every review, and the fused label.

    A review never stops the batch: absent scores, blank text or an absent model
    give the default values. The rule columns are computed inside the row and the
    text is dropped; what remains is shuffled once by review_id, and each signal
    joins it already reduced to one row per review.
    """
    scores, settings = scores or Scores(), settings or Settings()
    details = aspect_details(reviews, scores.aspects, settings)
    flagged = reviews.select("review_id", "text", text.is_blank("text").alias("_blank"))
    wide = lexicon.add_rule(flagged, settings.lexicon, modifiers=settings.modifiers).drop("text")
    wide = _add_sentiment(wide, scores.sentiment, settings)
    wide = absa.add_rollup(wide, details)
    wide = _add_emotion(wide, scores.emotions, settings)
    wide = _add_sarcasm(wide, scores.sarcasm)
    wide = wide.withColumn("sentiment_label", labels.label_of(F.col("sentiment")))
    emotion_columns = [e.lower() for e in settings.emotions]
    features = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in schemas.FEATURES}
    extra = ["valence_score", "polarity_score", "rule_label", "sentiment", "sentiment_label", *emotion_columns,
             "emotion_label", "top_emotion_score", "sarcasm_label"]
    wide = wide.withColumn("model_used", F.lit(settings.sentiment_model if scores.sentiment is not None else None).cast("string"))
    extra.append("model_used")
    signals = wide.select("review_id", *[c.alias(f) for f, c in features.items()], *extra)
    fused = fusion.fuse(signals, *model) if model else fusion.fuse_without_model(signals)
    return Analysis(fused, details)


def result_rows(signals: DataFrame) -> DataFrame:
    """The stored columns, with their defaults."""
    defaults = [
        ("overall_sentiment", "sentiment_label", "string", "neutral"),
        ("overall_score", "sentiment", "int", 0),
        ("emotion_label", "emotion_label", "string", "neutral"),
        ("emotion_score", "top_emotion_score", "double", 0.0),
        ("sarcasm_label", "sarcasm_label", "string", "not_sarcastic"),
        ("sarcasm_score", "sarcasm_score", "int", 0),
        ("fusion_label", "fused_label", "string", "neutral"),
        ("fusion_confidence", "fused_confidence", "double", 0.0),
    ]
    return signals.select(
        "review_id",
        *[F.coalesce(F.col(source).cast(kind), F.lit(value)).alias(name) for name, source, kind, value in defaults],
    )


def stamped(rows: DataFrame) -> DataFrame:
    """Add the audit columns of the result table."""
    return rows.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})
