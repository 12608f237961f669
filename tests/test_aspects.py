import pytest
from pyspark.sql import functions as F

from helpers import one, rows
from opinionloom import resources
from opinionloom.operators import aspects as absa
from opinionloom.operators import shaping


def found(df):
    return [r.aspect for r in absa.default_overall(df).orderBy("aspect_idx").collect()]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("I love this dish and all the dishes here.", ["dishes"]),
        ("The price was high but the pricing is clear", ["price", "pricing"]),
        ("Lovely day", ["overall"]),
        ("", ["overall"]),
        (None, ["overall"]),
        ("Service and FOOD", ["food", "service"]),
        ("One waitress, two waitresses, one waiter", ["waiter", "waitresses"]),
    ],
)
def test_extraction_and_plural_rule(reviews, text, expected):
    assert found(reviews(text)) == expected


def test_dictionary_size():
    assert len(resources.ASPECTS) == len(set(resources.ASPECTS)) == 181


def test_part_of_speech_gate(reviews):
    pos = {"cheap": shaping.ADJECTIVE, "food": shaping.NOUN, "wine": shaping.NOUN, "bar": shaping.NOUN}
    got = rows(absa.extract_aspects(reviews("cheap wine bar has food"), ["cheap", "food", "wine bar", "wine"], pos), "aspect")
    assert got == [("food",), ("wine bar",), ("wine",)] or got == [("food",), ("wine",), ("wine bar",)]


def test_table_dictionary_equals_inlined_one(spark, reviews):
    df = reviews("the main bar of the house", "bar bar", None, "house wine of the house")
    words = ["bar", "main bar", "house", "house wine", "of the house"]
    table = spark.createDataFrame([(w,) for w in words], "aspect string")
    expected = rows(absa.extract_aspects(df, words))
    assert rows(absa.extract_aspects(df, table)) == expected
    assert rows(absa.extract_aspects(df, table, max_inline=0)) == expected


def test_plural_rule_on_rows(spark):
    df = spark.createDataFrame(
        [(1, "dish"), (1, "dishes"), (1, "food"), (2, "dish"), (3, "price"), (3, "prices"), (3, "sauce")], "review_id int, aspect string"
    )
    assert rows(absa.prefer_plural_rows(df)) == [(1, "dishes"), (1, "food"), (2, "dish"), (3, "prices"), (3, "sauce")]


def test_units_skip_blank_text(reviews):
    assert rows(absa.aspect_units(reviews(" Good food ", " ", None)), "unit") == [("Good food [SEP] food",)]


@pytest.mark.parametrize(
    "label, score, name, signed, conf",
    [
        ("LABEL_2", 0.95, "positive", 0.95, 0.95),
        ("negative", 0.88, "negative", -0.88, 0.88),
        ("LABEL_1", 0.7, "neutral", 0.0, 0.7),
        ("LABEL_8", 0.7, "neutral", 0.0, 0.7),
        ("unknown", 0.6, "neutral", 0.0, 0.6),
        ("", 0.6, "neutral", 0.0, 0.6),
        ("positive", None, "neutral", 0.0, 0.0),
    ],
)
def test_aspect_label_contract(spark, label, score, name, signed, conf):
    df = spark.createDataFrame([(1, "food", 0, label, score)], "review_id int, aspect string, pos int, label string, score double")
    r = one(absa.aspect_sentiment(df))
    assert (r.sentiment_label, r.sentiment_score, r.confidence, r.raw_label) == (name, signed, conf, label)


@pytest.mark.parametrize(
    "text, aspect, window, expected",
    [
        ("The food was absolutely great and tasty for sure.", "great", 3, "food was absolutely great and tasty for"),
        ("Food was great and tasty.", "Food", 3, "Food was great and"),
        ("Service was great.", "great", 3, "Service was great"),
        ("Service was good.", "food", 3, ""),
        ("The food was good. Later the food was tasty.", "food", 1, "The food was the food was"),
        ("Short food text", "food", 10, "Short food text"),
        ("", "food", 10, ""),
        (None, "food", 10, ""),
        ("Some text here", "", 3, ""),
    ],
)
def test_context(spark, text, aspect, window, expected):
    df = spark.createDataFrame([(1, text, aspect)], "review_id int, text string, aspect string")
    assert one(absa.aspect_context(df, window)).context_phrase == expected


DETAILS = "review_id long, aspect string, sentiment_label string, sentiment_score double, confidence double, context_phrase string"


def test_rollup(spark, reviews):
    df = spark.createDataFrame([(0, "food", "positive", 0.9, 0.9, ""), (0, "bar", "negative", -0.6, 0.6, "")], DETAILS)
    got = absa.absa_rollup(reviews("x", ""), df).orderBy("review_id").collect()
    assert (got[0].num_pos_aspects, got[0].num_neg_aspects) == (1, 1)
    assert got[0].avg_aspect_score == pytest.approx(0.15) and got[0].avg_aspect_confidence == pytest.approx(0.75)
    assert tuple(got[1])[1:] == (0, 0, 0.0, 0.0)


def test_mentions_are_averaged(spark):
    df = spark.createDataFrame([(0, "food", "positive", 0.9, 0.9, ""), (0, "food", "negative", -0.5, 0.5, "")], DETAILS)
    r = one(absa.aggregate_mentions(df))
    assert r.sentiment_score == pytest.approx(0.2) and r.confidence == pytest.approx(0.7)
    assert (r.sentiment_label, r.pos_mentions, r.neg_mentions) == ("positive", 1, 1)


def test_clauses_have_their_own_label(spark):
    pairs = spark.createDataFrame([(1, "The food was amazing but the food was also too salty.", "food"), (2, "slow, but nice decor", "food")],
                                  "review_id long, text string, aspect string")
    scores = spark.createDataFrame(
        [(1, "food", 0, 0, "LABEL_2", 0.9), (1, "food", 1, 0, "LABEL_0", 0.8), (2, "food", 0, 0, "LABEL_2", 0.9)],
        "review_id long, aspect string, clause_idx int, pos int, label string, score double",
    )
    got = absa.clause_aspect_sentiment(shaping.contrast_clauses(pairs), scores)
    assert rows(got, "review_id", "clause_idx", "sentiment_label", "sentiment_score") == [
        (1, 0, "positive", 0.9), (1, 1, "negative", -0.8), (2, 0, "neutral", 0.0)
    ]


@pytest.mark.parametrize(
    "context, label, score",
    [
        ("oh wonderful only bad food", "negative", -0.8),
        ("oh wonderful good food", "positive", 0.8),
        ("only bad food", "positive", 0.8),
        ("good food", "positive", 0.8),
    ],
)
def test_sarcastic_flip(spark, context, label, score):
    df = spark.createDataFrame([(0, "food", "positive", 0.8, 0.8, context)], DETAILS)
    r = one(absa.flip_sarcastic_aspect(df))
    assert (r.sentiment_label, r.sentiment_score) == (label, score)


def test_categories_keep_the_largest_id(spark):
    details = spark.createDataFrame([(0, "food", "positive", 0.8, 0.9, ""), (0, "wine", "neutral", 0.0, 0.1, "")], DETAILS)
    categories = spark.createDataFrame([(1, "Food"), (5, "food"), (7, "bar")], "category_id int, aspect string")
    assert rows(absa.map_categories(details, categories)) == [(0, 5, "food", "positive", 0.8, 0.9)]
    assert rows(absa.unmapped_aspects(details, categories)) == [("wine", 1)]


def test_aspects_alone_need_no_tokens(spark):
    found = spark.range(2).selectExpr("id AS review_id", "concat('Good food ', id) AS text", "array('food', 'staff') AS found")
    contexts = absa.exploded_contexts(found)
    alone = contexts.select("review_id", "aspect")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in alone
    assert {(r.aspect, r.context_phrase) for r in contexts.where("review_id = 1").collect()} == {("food", "Good food 1"), ("staff", "")}


def test_aspects_are_found_once_before_they_are_exploded(spark):
    reviews = spark.createDataFrame([(1, "Nice food. The dishes, hot dish!"), (2, "nothing-much"), (3, "x"), (4, "DISHES’s Food’s. ÉFood food")], "review_id long, text string")
    listed = absa.add_aspect_arrays(reviews, ["food", "dish", "dishes", "nothing"])
    found = absa.exploded_contexts(listed).select("review_id", "aspect")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "dishes"), (1, "food"), (2, "nothing"), (3, "overall"), (4, "food")]
    marks = reviews.select("review_id", F.sort_array(absa.aspect_array(["food", "!", "-", "."])).alias("a")).orderBy("review_id")
    assert [r.a for r in marks.collect()] == [["!", ".", "food"], ["-"], [], [".", "food"]]
