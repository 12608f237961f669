import math

import pytest
from pyspark.sql import functions as F

from helpers import one, rows
from opinionloom import schemas
from opinionloom.functions import cues
from opinionloom.operators import emotion, fusion, sarcasm
from opinionloom.plans import analyze

EMO = "review_id long, clause_idx int, label string, score double"


def filled(spark, reviews, *scores):
    df = spark.createDataFrame([(0, 0, label, s) for label, s in scores] or [(9, 0, "joy", 0.5)], EMO)
    return emotion.emotion_fill(reviews("x"), df)


def test_pool_takes_the_largest_known_label(spark):
    df = spark.createDataFrame([(0, 0, "Joy", 0.2), (0, 1, "joy", 0.6), (0, 1, "disgust", 0.9)], EMO)
    assert rows(emotion.emotion_max_pool(df)) == [(0, "joy", 0.6)]
    assert rows(emotion.emotion_max_pool(df, ["JOY"])) == [(0, "joy", 0.6)]


@pytest.mark.parametrize(
    "scores, entropy",
    [
        ([("joy", 0.1), ("fear", 0.1)], 0.0),
        ([("joy", 0.9), ("fear", 0.1)], 0.0),
        ([("joy", 0.4), ("fear", 0.4)], math.log(2) / math.log(6)),
        ([(e, 0.3) for e in ("sadness", "joy", "love", "anger", "fear", "surprise")], 1.0),
        ([], 0.0),
    ],
)
def test_entropy(spark, reviews, scores, entropy):
    r = one(emotion.emotion_entropy(filled(spark, reviews, *scores)))
    assert r.emotion_distribution == pytest.approx(entropy)


def test_totals_and_winner(spark, reviews):
    df = filled(spark, reviews, ("joy", 0.6), ("love", 0.6), ("fear", 0.3))
    r = one(emotion.emotion_signals(df))
    assert r.emotion_score == pytest.approx(1.5) and r.emotion_confidence == pytest.approx(0.25)
    assert (r.emotion_label, r.top_emotion_score) == ("joy", 0.6)
    assert one(emotion.top_emotion(filled(spark, reviews))).emotion_label == "sadness"
    assert one(emotion.top_emotion(filled(spark, reviews), [])).emotion_label == "neutral"


@pytest.mark.parametrize(
    "label, flag",
    [("LABEL_1", 1), ("label_0", 0), (" Sarcastic ", 1), ("Not Sarcastic", 0), ("NOT_SARCASTIC", 0), ("ironic", 0), (None, 0)],
)
def test_sarcasm_keeps_confidence(spark, reviews, label, flag):
    best = spark.createDataFrame([(0, label, 0.7)], "review_id long, label string, score double")
    got = sarcasm.sarcasm_result(reviews("a", "b"), best).orderBy("review_id").collect()
    assert (got[0].sarcasm_score, got[0].sarcasm_confidence) == (flag, 0.7)
    assert tuple(got[1])[1:] == ("not_sarcastic", 0, 0.0)


@pytest.mark.parametrize(
    "text, score",
    [
        ("fine!!", 0.0), ("fine!!!", 0.3), ("we measure", 0.6), ("is it perfect?", 0.4), ("Oh great? Sure!!!", 1.0),
        ("perfect ?", 0.0), (None, 0.0), ("Oh Joy", 0.6),
    ],
)
def test_sarcastic_context(spark, text, score):
    df = spark.createDataFrame([(text,)], "text string").select(cues.sarcastic_context(F.col("text")).alias("s"))
    assert one(df).s == pytest.approx(score)


def test_hidden_sentiment_is_literal_unless_asked(reviews):
    df = reviews("It reminds me of home if it were lost", "reminds me of.*if.*lost", "ADEQUATE", "fine", None)
    assert [r[1] for r in fusion.hidden_sentiment(df).collect()] == [0.0, -0.6, -0.6, 0.0, 0.0]
    assert [r[1] for r in fusion.hidden_sentiment(df, regex=True).collect()][:3] == [-0.6, -0.6, -0.6]


def test_contradiction_and_balance(spark, reviews):
    got = [r[1] for r in fusion.contradiction(reviews("great butter", "great", "but", None)).collect()]
    assert got == [1.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(0, 0), (2, 2), (3, 1), (0, 5)], "num_pos_aspects int, num_neg_aspects int")
    assert [r.aspect_balance for r in fusion.aspect_balance(df).collect()] == [0.0, 1.0, 0.5, 0.0]


def test_features_without_any_classifier(reviews):
    a = analyze.analyze_reviews(reviews("The food was really great.", None, ""))
    assert a.details.count() == 0
    got = a.signals.orderBy("review_id").collect()
    assert len(got) == 3
    assert got[0].rule_score == 1.0 and got[1].rule_score == 0.0
    assert all(r.fused_label == "neutral" and r.fused_confidence == 0.0 for r in got)
    assert all(r[f] is not None for r in got for f in schemas.FEATURES)


def test_analysis_with_scores(spark, reviews):
    score = "review_id long, model string, pos int, label string, score double"
    scores = analyze.Scores(
        sentiment=spark.createDataFrame([(0, "siebert/sentiment-roberta-large-english", 0, "LABEL_0", 0.7)], score),
        aspects=spark.createDataFrame([(0, "food", 0, "LABEL_2", 0.9), (0, "service", 0, "LABEL_0", 0.6)],
                                      "review_id long, aspect string, pos int, label string, score double"),
        emotions=spark.createDataFrame([(0, 0, "joy", 0.9)], EMO),
        sarcasm=spark.createDataFrame([(0, "s", 0, "LABEL_1", 0.8)], score),
    )
    a = analyze.analyze_reviews(reviews("Great food, slow service", "Nothing"), scores)
    first = a.signals.orderBy("review_id").first()
    assert (first.sentiment_score, first.num_pos_aspects, first.num_neg_aspects) == (-0.7, 1.0, 1.0)
    assert first.avg_aspect_score == pytest.approx(0.15) and first.sarcasm_score == 1.0 and first.emotion_label == "joy"
    assert rows(a.details, "review_id", "aspect", "sentiment_label") == [
        (0, "food", "positive"), (0, "service", "negative"), (1, "nothing", "neutral")
    ]
    stored = analyze.result_rows(a.signals).orderBy("review_id").first()
    assert (stored.overall_sentiment, stored.overall_score, stored.sarcasm_label) == ("negative", -1, "sarcastic")
