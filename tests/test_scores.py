import pytest
from pyspark.sql import functions as F

from helpers import rows
from opinionloom import resources
from opinionloom.operators import scoring
from workload import inputs

SCORES = "review_id long, unit_id int, model string, pos int, label string, score double"
FIVE = "pig4431/YELP_roBERTa_5E"
REVERSED = "dnzblgn/Sentiment-Analysis-Customer-Reviews"


def test_first_label_wins_a_tie_and_missing_counts_as_zero(spark):
    df = spark.createDataFrame(
        [(1, 0, "m", 0, "a", 0.5), (1, 0, "m", 1, "b", 0.5), (2, 0, "m", 0, "a", None), (2, 0, "m", 1, "b", 0.0),
         (3, 0, "m", 0, "a", None), (3, 0, "m", 1, "b", 0.1)],
        SCORES,
    )
    assert rows(scoring.argmax_label(df), "review_id", "label") == [(1, "a"), (2, "a"), (3, "b")]


@pytest.mark.parametrize(
    "model, label, text_label, conf",
    [
        (REVERSED, "LABEL_0", "positive", 1.0),
        (REVERSED, "1", "negative", 1.0),
        (FIVE, "label_4", "very_positive", 1.0),
        (FIVE, "LABEL_9", "neutral", 1.0),
        (FIVE, "LABEL_x", "label_x", 0.5),
        (FIVE, " Very Negative ", "very_negative", 1.0),
        (FIVE, "NEU_sentiment", "neutral", 1.0),
        (FIVE, "Mixed", "mixed", 1.0),
        (FIVE, None, "neutral", 0.3),
        ("unknown", "LABEL_1", "neutral", 1.0),
    ],
)
def test_label_normalisation(spark, model, label, text_label, conf):
    best = spark.createDataFrame([(1, 0, model, label, 0.9)], "review_id long, unit_id int, model string, label string, score double")
    r = scoring.normalize_labels(best, scoring.catalog_label_map(spark)).first()
    assert (r.text_label, r.mapping_conf) == (text_label, conf)


def test_sentiment_result_has_defaults(spark, reviews):
    df = reviews("fine", " ", None, "no score", "null score")
    best = spark.createDataFrame(
        [(i, "m", label, score, label, 0.5) for i, label, score in [(0, "very_positive", 0.8), (1, "positive", 0.9), (4, "negative", None)]],
        "review_id long, model string, label string, score double, text_label string, mapping_conf double",
    )
    got = scoring.signed_score(scoring.sentiment_result(df, best, "m"))
    assert rows(got, "review_id", "sentiment", "confidence", "sentiment_score") == [
        (0, 1, 0.4, 0.4), (1, 0, 0.0, 0.0), (2, 0, 0.0, 0.0), (3, 0, 0.0, 0.0), (4, 0, 0.0, 0.0)
    ]


def test_calibration_uses_the_later_probe(spark):
    probes = spark.createDataFrame([(i, e) for i, (_, e) in enumerate(resources.PROBES)], "probe_id long, expected string")
    scores = spark.createDataFrame(
        [(0, 0, "m", 0, "LABEL_1", 0.9), (1, 0, "m", 0, "LABEL_0", 0.9), (2, 0, "m", 0, "LABEL_1", 0.9),
         (0, 0, "w", 0, "Positive", 0.9), (1, 0, "w", 0, "NEGATIVE", 0.9), (2, 0, "w", 0, "other", 0.9)],
        SCORES,
    )
    assert rows(scoring.calibrate_label_map(scores, probes)) == [
        ("m", 0, "negative"), ("m", 1, "neutral"), ("w", 0, "negative"), ("w", 1, "positive")
    ]


def test_calibration_ranks_the_scores_of_the_probes_alone(spark):
    probes = spark.createDataFrame([(3, "positive"), (None, "negative")], "probe_id long, expected string")
    scores = spark.createDataFrame([(i, 0, "m", p, f"LABEL_{p}", 0.9 if p == i % 2 else 0.1) for i in range(50) for p in (0, 1)], SCORES)
    got = scoring.calibrate_label_map(scores, probes)
    assert rows(got) == [("m", 1, "positive")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("max_by(") < plan.index("LeftSemi")


def test_best_label_keeps_a_missing_score(spark):
    scores = spark.createDataFrame(
        [(1, 0, "m", 0, "a", None), (1, 0, "m", 1, "b", 0.0), (2, 0, "m", 0, "a", 0.2), (2, 0, "m", 1, None, 0.7), (2, 0, "m", 2, "c", 0.7),
         (3, 1, "m", 0, "a", 0.5), (3, 0, "m", 1, "b", 0.5), (4, 0, "m", 0, "a", -0.1), (4, 0, "m", 1, "b", None)],
        SCORES,
    )
    best = scoring.argmax_label(scores, ("review_id",))
    assert rows(best) == [(1, "a", None), (2, None, 0.7), (3, "b", 0.5), (4, "b", None)]


def test_rows_made_in_place_are_written_without_a_shuffle(spark, tmp_path):
    def thirds(spark, sf_dir):
        return spark.range(0, 90, 1, 3).withColumnRenamed("id", "review_id")

    table = inputs.stored_in_place(thirds)(spark, str(tmp_path))
    parts = table.groupBy(F.input_file_name().alias("file")).agg(F.min("review_id").alias("low"), F.max("review_id").alias("high"))
    assert rows(parts.select("low", "high")) == [(0, 29), (30, 59), (60, 89)]


def test_label_map_from_names(spark):
    df = spark.createDataFrame(
        [("two", 0, "LABEL_3"), ("two", 1, "LABEL_5"), ("three", 0, "LABEL_0"), ("three", 1, "LABEL_1"), ("three", 2, "LABEL_2"),
         ("named", 0, "bad_neg"), ("named", 1, "meh"), ("named", 2, "Positive")],
        "model string, pos int, label string",
    )
    assert rows(scoring.infer_label_map(df)) == [
        ("named", 0, "negative"), ("named", 1, "neutral"), ("named", 2, "positive"),
        ("three", 0, "negative"), ("three", 1, "neutral"), ("three", 2, "positive"),
        ("two", 3, "negative"), ("two", 5, "positive"),
    ]


def test_model_comparison_fills_gaps(spark, reviews):
    normalized = spark.createDataFrame(
        [(0, "a", "positive", 0.8, 1.0), (0, "b", "very_negative", 0.6, 0.5), (1, "a", "positive", 0.8, 1.0)],
        "review_id long, model string, text_label string, score double, mapping_conf double",
    )
    got = scoring.compare_models(reviews("x", " ", "y"), normalized, ["a", "b"])
    assert rows(got, "review_id", "sentiment_1", "sentiment_2", "confidence_2", "n_opinions") == [
        (0, 1, -1, 0.3, 2), (1, 0, 0, 0.0, 1), (2, 0, 0, 0.0, 1)
    ]


def test_batch_scorer_keeps_class_order(reviews):
    def load():
        return lambda texts: [[("short", 1.0 if len(t) < 3 else 0.0), ("long", float(len(t)))] for t in texts]

    units = reviews("ab", "abcd").withColumn("unit_id", F.lit(7))
    got = rows(scoring.score_units(units, load, "len"))
    assert got == [(0, 7, "len", 0, "short", 1.0), (0, 7, "len", 1, "long", 2.0), (1, 7, "len", 0, "short", 0.0), (1, 7, "len", 1, "long", 4.0)]


def test_catalog(spark):
    assert scoring.model_catalog(spark).count() == 12
    info = scoring.model_info(spark, REVERSED).first()
    assert info.label_mapping == {0: "positive", 1: "negative"} and info.num_classes == 2
    assert scoring.model_info(spark, "none such").count() == 0
