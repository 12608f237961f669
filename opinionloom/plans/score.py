"""From review texts to the score tables of the analysis."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import aspects as absa
from ..operators import scoring, shaping
from ..operators.scoring import Scorer
from .analyze import Scores, Settings


@dataclass
class Classifier:
    """A fitted pipeline, or a function that loads a model and returns its batch function."""

    name: str
    scorer: PipelineModel | Scorer
    class_labels: Sequence[str] = ()


@dataclass
class Scorers:
    """The classifiers of a run; None where there is none."""

    sentiment: Classifier | None = None
    aspects: Classifier | None = None
    emotions: Classifier | None = None
    sarcasm: Classifier | None = None


def score_reviews(reviews: DataFrame, scorers: Scorers, settings: Settings | None = None) -> Scores:
    """Score each review(review_id, text) for every classifier given.

    Sentiment sees the normalised text, aspects the text with each aspect, emotions the
    clauses, sarcasm the text itself. Blank texts are not scored.
    """
    settings = settings or Settings()
    usable = reviews.select("review_id", "text").where(~text.is_blank("text"))

    def run(classifier: Classifier | None, units: DataFrame, keys: Sequence[str]) -> DataFrame | None:
        if classifier is None:
            return None
        return scoring.score_units(units, classifier.scorer, classifier.name, classifier.class_labels, keys, as_array=True)

    normalized = usable.select("review_id", text.normalized("text").alias("text"))
    pairs = absa.aspect_units(usable, settings.aspects, pos=settings.pos).withColumnRenamed("unit", "text")
    clauses = shaping.emotion_clauses(usable).select("review_id", "clause_idx", F.col("clause").alias("text"))
    return Scores(
        sentiment=run(scorers.sentiment, normalized, ["review_id"]),
        aspects=run(scorers.aspects, pairs, ["review_id", "aspect"]),
        emotions=run(scorers.emotions, clauses, ["review_id", "clause_idx"]),
        sarcasm=run(scorers.sarcasm, usable, ["review_id"]),
    )
