"""Emotion, sarcasm and fusion features."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from opinionloom import resources as R
from opinionloom import schemas
from opinionloom.operators import aspects as absa
from opinionloom.operators import emotion, fusion, lexicon, sarcasm, scoring, training
from opinionloom.plans import analyze
from opinionloom.sinks import files

from . import inputs as I
from .aspect_queries import ROLLUP
from .registry import query, rounded
from .text_queries import OPINION_RULE


def filled(spark, sf_dir):
    return emotion.emotion_fill(I.opinions(spark, sf_dir), I.emotion_scores(spark, sf_dir))


@query(f"WITH {I.EMOTION_SCORES} SELECT review_id, label, score FROM pooled")
def emotion_pool(spark, sf_dir):
    return emotion.emotion_max_pool(I.emotion_scores(spark, sf_dir))


@query(f"WITH {I.EMOTION_SCORES} SELECT review_id, label_pos::INT AS label_pos, label, score FROM filled")
def emotion_fill(spark, sf_dir):
    return emotion.emotion_rows(filled(spark, sf_dir))


@query(f"""WITH {I.EMOTION_SCORES}, {I.EMOTION_TOTALS}
SELECT review_id, round(emotion_score, 9) AS emotion_score, round(emotion_confidence, 9) AS emotion_confidence FROM emotion""")
def emotion_totals(spark, sf_dir):
    return rounded(emotion.emotion_totals(filled(spark, sf_dir)))


@query(f"""WITH {I.EMOTION_SCORES}, {I.EMOTION_TOTALS}
SELECT review_id, round(emotion_distribution, 9) AS emotion_distribution FROM emotion""")
def emotion_entropy(spark, sf_dir):
    return rounded(emotion.emotion_entropy(filled(spark, sf_dir)))


TOP_EMOTION = """top_emotion AS (
  SELECT review_id, label AS emotion_label, score AS top_emotion_score
  FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY score DESC, label_pos) AS rn FROM filled) WHERE rn = 1)"""


@query(f"WITH {I.EMOTION_SCORES}, {TOP_EMOTION} SELECT * FROM top_emotion")
def top_emotion(spark, sf_dir):
    return emotion.top_emotion(filled(spark, sf_dir))


@query(f"WITH {I.SARCASM_SCORES} SELECT * FROM sarcasm")
def sarcasm_result(spark, sf_dir):
    best = scoring.argmax_label(I.sarcasm_scores(spark, sf_dir), ("review_id",))
    return sarcasm.sarcasm_result(I.opinions(spark, sf_dir), best)


def _without(prefix: str, sql: str) -> str:
    """`sql` without the leading block that another block already defines."""
    return sql.replace(f"{prefix},\n", "", 1)


FEATURE_TABLES = (
    f"{OPINION_RULE}, {I.SENTIMENT_SCORES}, {I.NORMALIZED}, {I.sentiment_sql(I.TWO_WAY)}, "
    f"{_without(I.OPINIONS, I.ASPECT_SENTIMENT)}, {ROLLUP}, "
    f"{_without(I.OPINIONS, I.EMOTION_SCORES)}, {I.EMOTION_TOTALS}, {I.SARCASM_SCORES}"
)
FEATURES_SQL = """features AS (
  SELECT o.review_id,
    CASE WHEN rule_polarity >= 0.05 THEN 1.0 WHEN rule_polarity <= -0.05 THEN -1.0 ELSE 0.0 END::DOUBLE AS rule_score,
    rule_polarity, sentiment * s.confidence AS sentiment_score, s.confidence AS sentiment_confidence,
    num_pos_aspects::DOUBLE AS num_pos_aspects, num_neg_aspects::DOUBLE AS num_neg_aspects,
    avg_aspect_score, avg_aspect_confidence, emotion_score, emotion_confidence, emotion_distribution,
    sarcasm_score::DOUBLE AS sarcasm_score, sarcasm_confidence
  FROM opinions o LEFT JOIN rule USING (review_id) LEFT JOIN sentiment s ON s.review_id = o.review_id
  LEFT JOIN absa a ON a.review_id = o.review_id LEFT JOIN emotion e ON e.review_id = o.review_id
  LEFT JOIN sarcasm c ON c.review_id = o.review_id)"""
ROUNDED_FEATURES = ", ".join(f"round({f}, 9) + 0.0::DOUBLE AS {f}" for f in schemas.FEATURES)


def feature_table(spark, sf_dir):
    reviews = I.opinions(spark, sf_dir)
    chosen = I.sentiment_scores(spark, sf_dir).where(F.col("model") == I.TWO_WAY)
    # Grouped by review_id alone, so the result is already placed for the join.
    best = scoring.argmax_label(chosen, ("review_id",)).withColumn("model", F.lit(I.TWO_WAY))
    normalized = scoring.normalize_labels(best, scoring.catalog_label_map(spark))
    return fusion.fusion_features(
        reviews,
        lexicon.rule_sentiment(reviews),
        scoring.signed_score(scoring.sentiment_signals(normalized, I.TWO_WAY)),
        absa.aspect_signals(absa.aspect_sentiment(I.aspect_scores(spark, sf_dir))),
        emotion.emotion_signals(emotion.pooled_emotions(I.emotion_scores(spark, sf_dir))),
        sarcasm.sarcasm_signals(scoring.argmax_label(I.sarcasm_scores(spark, sf_dir), ("review_id",))),
    )


@query(f"WITH {FEATURE_TABLES}, {FEATURES_SQL} SELECT review_id, {ROUNDED_FEATURES} FROM features")
def fusion_features(spark, sf_dir):
    return rounded(feature_table(spark, sf_dir))


_NO_MODEL = "'neutral' AS fused_label, 0.0::DOUBLE AS fused_confidence"


@query(f"WITH {FEATURE_TABLES}, {FEATURES_SQL} SELECT review_id, {ROUNDED_FEATURES}, {_NO_MODEL} FROM features")
def fuse_without_model(spark, sf_dir):
    return rounded(fusion.fuse_without_model(feature_table(spark, sf_dir)))


@I.stored
def training_rows(spark, sf_dir):
    """The feature table with the order status as the class to learn, as an earlier run stored it."""
    status = F.col("o_orderstatus")
    label = F.when(status == "F", "positive").when(status == "O", "negative").otherwise("neutral").alias("label")
    classes = I.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), label)
    return feature_table(spark, sf_dir).join(classes, "review_id")


def fitted(spark, sf_dir):
    """The published fusion model of the session; trained on first use."""
    directory = I.session_folder(spark, sf_dir, "models")
    try:
        return files.load_latest_model(spark, directory)
    except AnalysisException:  # nothing published yet
        model, classes = training.fit_fusion(training_rows(spark, sf_dir))
        files.publish_model(spark, model, classes, directory, "v1")
        return model, classes


def _facts(fused, classes):
    """What must hold of any forest's answer: a known class, and a confidence no class could beat."""
    confidence = F.col("fused_confidence")
    return fused.withColumns(
        {
            "known_label": F.col("fused_label").isin(classes).cast("int"),
            "fair_confidence": ((confidence >= 1 / len(classes) - 1e-9) & (confidence <= 1 + 1e-9)).cast("int"),
        }
    )


@query("SELECT o_orderkey AS review_id, 1 AS known_label, 1 AS fair_confidence FROM orders")
def fuse(spark, sf_dir):
    """Every order has an answer of the forest; its values are random-forest specific, so facts are compared."""
    model, classes = fitted(spark, sf_dir)
    fused = fusion.fuse(training_rows(spark, sf_dir).drop("label"), model, classes)
    return _facts(fused, classes).select("review_id", "known_label", "fair_confidence")


def scores(spark, sf_dir):
    return analyze.Scores(
        sentiment=I.sentiment_scores(spark, sf_dir),
        aspects=I.aspect_scores(spark, sf_dir),
        emotions=I.emotion_scores(spark, sf_dir),
        sarcasm=I.sarcasm_scores(spark, sf_dir),
    )


def analysis(spark, sf_dir, model=None):
    settings = analyze.Settings(sentiment_model=I.TWO_WAY)
    return analyze.analyze_reviews(I.opinions(spark, sf_dir), scores(spark, sf_dir), settings, model)


@I.stored
def stored_signals(spark, sf_dir):
    """Signals without a fusion model, as an earlier run stored them."""
    return analysis(spark, sf_dir).signals


ANALYSIS_COLUMNS = ["rule_label", "sentiment", "sentiment_label", "emotion_label", "top_emotion_score", "sarcasm_label"]
ANALYSIS_SQL = """CASE WHEN f.rule_score > 0 THEN 'positive' WHEN f.rule_score < 0 THEN 'negative' ELSE 'neutral' END AS rule_label,
s.sentiment, CASE s.sentiment WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
t.emotion_label, t.top_emotion_score, c.sarcasm_label"""
ANALYSIS_JOINS = """features f JOIN sentiment s ON s.review_id = f.review_id JOIN top_emotion t ON t.review_id = f.review_id
JOIN sarcasm c ON c.review_id = f.review_id"""
_F_ROUNDED = ", ".join(f"round(f.{c}, 9) + 0.0::DOUBLE AS {c}" for c in schemas.FEATURES)


@query(f"""WITH {FEATURE_TABLES}, {FEATURES_SQL}, {TOP_EMOTION}
SELECT f.review_id, {_F_ROUNDED}, {ANALYSIS_SQL}, 1 AS known_label, 1 AS fair_confidence FROM {ANALYSIS_JOINS}""")
def analyze_reviews(spark, sf_dir):
    """All signals of the whole plan; of the forest's answer, the facts."""
    model, classes = fitted(spark, sf_dir)
    signals = _facts(analysis(spark, sf_dir, (model, classes)).signals, classes)
    return rounded(signals.select("review_id", *schemas.FEATURES, *ANALYSIS_COLUMNS, "known_label", "fair_confidence"))


@query(f"""WITH {FEATURE_TABLES}, {FEATURES_SQL}, {TOP_EMOTION}
SELECT f.review_id, CASE s.sentiment WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS overall_sentiment,
       s.sentiment AS overall_score, emotion_label, top_emotion_score AS emotion_score, sarcasm_label,
       c.sarcasm_score AS sarcasm_score, 'neutral' AS fusion_label, 0.0::DOUBLE AS fusion_confidence
FROM features f JOIN sentiment s ON s.review_id = f.review_id JOIN top_emotion t ON t.review_id = f.review_id
JOIN sarcasm c ON c.review_id = f.review_id""")
def result_rows(spark, sf_dir):
    return analyze.result_rows(stored_signals(spark, sf_dir))


def _any(phrases) -> str:
    return "coalesce(" + " OR ".join(f"contains(lower(text), {I.quoted(p)})" for p in phrases) + ", false)"


HIDDEN = f"CASE WHEN {_any(R.HIDDEN_NEGATIVE)} THEN -0.6 ELSE 0.0 END::DOUBLE AS hidden_sentiment"
CONTEXT = (
    f"least(1.0::DOUBLE, CASE WHEN {_any(R.SARCASM_CUES)} THEN 0.6::DOUBLE ELSE 0 END"
    " + CASE WHEN length(text) - length(replace(text, '!', '')) > 2 THEN 0.3::DOUBLE ELSE 0 END"
    f" + CASE WHEN {_any([p + '?' for p in R.QUESTIONED_POSITIVES])} THEN 0.4::DOUBLE ELSE 0 END) AS sarcasm_context_score"
)
CONTRADICTION = (
    f"CASE WHEN {_any(R.CONTRADICTION_POSITIVES)} AND {_any(R.CONTRADICTION_CONTRASTS)} "
    "THEN 1.0 ELSE 0.0 END::DOUBLE AS contradiction_score"
)
BALANCE = (
    "CASE WHEN num_pos_aspects + num_neg_aspects = 0 THEN 0.0 "
    "ELSE 1 - abs(num_pos_aspects - num_neg_aspects) / (num_pos_aspects + num_neg_aspects) END::DOUBLE AS aspect_balance"
)


@query(f"WITH {I.OPINIONS} SELECT review_id, {HIDDEN} FROM opinions")
def hidden_sentiment(spark, sf_dir):
    return fusion.hidden_sentiment(I.opinions(spark, sf_dir))


@query(f"WITH {I.OPINIONS} SELECT review_id, round({CONTEXT.replace(' AS sarcasm_context_score', '')}, 9) AS sarcasm_context_score FROM opinions")
def sarcastic_context(spark, sf_dir):
    return rounded(fusion.sarcastic_context(I.opinions(spark, sf_dir)))


@query(f"""WITH {I.ASPECT_SENTIMENT}, {ROLLUP}
SELECT review_id, num_pos_aspects, num_neg_aspects, round({BALANCE.replace(' AS aspect_balance', '')}, 9) AS aspect_balance FROM absa""")
def aspect_balance(spark, sf_dir):
    details = absa.aspect_sentiment(I.aspect_scores(spark, sf_dir))
    signals = absa.absa_rollup(I.opinions(spark, sf_dir), details)
    return rounded(fusion.aspect_balance(signals.select("review_id", "num_pos_aspects", "num_neg_aspects")))


@query(f"WITH {I.OPINIONS} SELECT review_id, {CONTRADICTION} FROM opinions")
def contradiction(spark, sf_dir):
    return fusion.contradiction(I.opinions(spark, sf_dir))


@query(f"""WITH {I.ASPECT_SENTIMENT}, {ROLLUP}
SELECT review_id, num_pos_aspects, num_neg_aspects, {HIDDEN},
       round({CONTEXT.replace(' AS sarcasm_context_score', '')}, 9) AS sarcasm_context_score, {CONTRADICTION},
       round({BALANCE.replace(' AS aspect_balance', '')}, 9) AS aspect_balance
FROM absa JOIN opinions USING (review_id)""")
def advanced_features(spark, sf_dir):
    reviews = I.opinions(spark, sf_dir)
    rollup = absa.absa_rollup(reviews, absa.aspect_sentiment(I.aspect_scores(spark, sf_dir)))
    signals = rollup.select("review_id", "num_pos_aspects", "num_neg_aspects").join(reviews, "review_id")
    return rounded(fusion.advanced_features(signals).drop("text"))
