import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helpers import one, rows
from opinionloom.operators import lexicon, shaping
from opinionloom.resources import Lexicon

LEX = Lexicon(
    valence={"good": 2000, "bad": -2000}, polarity={"good": 700, "bad": -600, "red": 0}, boosters={"very": 293}, negators=("not",)
)


def compound(s):
    return s / math.sqrt(s * s + 15)


@pytest.mark.parametrize(
    "text, total, polarity",
    [
        ("good food", 2.0, 0.7),
        ("very good food", 2.293, 0.7),
        ("not good food", -1.48, 0.7),
        ("not very good food", -0.74 * 2.293, 0.7),
        ("isn't bad here", 1.48, -0.6),
        ("good food!!", 2.0 + 2 * 0.292, 0.7),
        ("bad food!!!!!!", -2.0 - 4 * 0.292, -0.6),
        ("a red car", 0.0, 0.0),
        ("good and bad", 0.0, 0.05),
        ("nothing known", 0.0, 0.0),
    ],
)
def test_unit_scores(reviews, text, total, polarity):
    r = one(lexicon.unit_scores(shaping.meaningful_sentences(reviews(text)), LEX))
    assert r.valence == pytest.approx(compound(total))
    assert r.polarity == pytest.approx(polarity)


def test_label_boundaries_are_inclusive(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (-0.0499,), (0.0,)], "rule_polarity double")
    got = [(r.rule_label, r.rule_score) for r in lexicon.rule_label(df).collect()]
    assert got == [("positive", 1), ("negative", -1), ("neutral", 0), ("neutral", 0), ("neutral", 0)]


def test_one_row_per_review_also_without_words(reviews):
    got = rows(lexicon.rule_sentiment(reviews("Good food. Good day!", None, "", "👍"), LEX), "review_id", "rule_label")
    assert got == [(0, "positive"), (1, "neutral"), (2, "neutral"), (3, "neutral")]


def test_inlined_and_joined_lexicon_agree(spark, reviews):
    df = reviews("Very good food. It is not very bad! Good, good.", None, "word " * 500 + "bad", "Good? Not good.")
    table = spark.createDataFrame(
        [("good", 2000, 700), ("bad", -2000, -600), ("red", None, 0)], "token string, valence_milli int, polarity_milli int"
    )
    inline = lexicon.rule_sentiment(df, table, LEX)
    joined = lexicon.rule_sentiment(df, table, LEX, max_inline=0)
    digits = [F.round(c, 9).alias(c) for c in ("valence_score", "polarity_score", "rule_polarity")]
    assert rows(inline.select("review_id", *digits)) == rows(joined.select("review_id", *digits))
    assert rows(inline, "review_id", "rule_label") == rows(lexicon.rule_sentiment(df, LEX), "review_id", "rule_label")


def test_repeated_words_and_repeated_ids_do_not_depend_on_the_size(spark):
    df = spark.createDataFrame([(1, "Good food. Not good."), (1, "Good food. Not good."), (1, "bad"), (None, None)], "review_id long, text string")
    table = spark.createDataFrame(
        [("good", 2000, 700), ("good", 1000, 900), ("bad", -2000, None), ("bad", None, -600)], "token string, valence_milli int, polarity_milli int"
    )
    inline, joined = (lexicon.rule_sentiment(df, table, LEX, max_inline=n) for n in (100, 0))
    assert inline.count() == 4 and sorted(map(str, inline.collect())) == sorted(map(str, joined.collect()))
    wide = df.withColumn("other", F.lit(1))
    assert sorted(map(str, lexicon.add_rule(wide, table, modifiers=LEX).collect())) == sorted(map(str, lexicon.add_rule(wide, table, modifiers=LEX, max_inline=0).collect()))


def test_a_large_dictionary_is_found_word_by_word(reviews):
    big = Lexicon(valence={f"w{i}": i % 7 * 100 for i in range(5000)}, polarity={f"w{i}": 100 for i in range(5000)})
    r = one(lexicon.unit_scores(shaping.meaningful_sentences(reviews("w1 w4999 w5000 w2")), big))
    assert r.polarity == pytest.approx(0.1)
    assert r.valence == pytest.approx(compound((1 + 4999 % 7 + 2) * 0.1))


FULL = replace(LEX, capitals=True, contrast=("but",), idioms={"kiss of death": -1500, "bad ass": 1500, "of death": -900, "death bad": 400})


@pytest.mark.parametrize(
    "text, total",
    [
        ("good food", 2.0),
        ("GOOD food", 2.733),
        ("GOOD FOOD", 2.0),
        ("VERY good food", 2.0 + 0.293 + 0.733),
        ("not BAD here", 0.74 * 2.733),
        ("good food but bad place", 2.0 * 0.5 - 2.0 * 1.5),
        ("good but not bad but good", 1.0 + 0.74 * 3.0 - 0.74 * 3.0),  # the negator is three words before the last one
        ("but good", 3.0),
        ("a bad ass place", 1.5),
        ("a very bad ass place", 1.793),
        ("the kiss of death here", -1.5),
        ("kiss of death bad ass", -1.5 + 1.5),
        ("smell of death bad", -0.9 - 2.0),
        ("bad", -2.0),
        ("good but a Bad Ass", 1.0 + 2.25),
        ("", 0.0),
    ],
)
def test_capitals_contrast_and_idioms(reviews, text, total):
    units = reviews(text).select("review_id", F.lit(0).alias("unit_idx"), F.col("text").alias("unit"))
    assert one(lexicon.unit_scores(units, FULL)).valence == pytest.approx(compound(total))


def test_each_rule_is_off_unless_given(reviews):
    units = shaping.meaningful_sentences(reviews("GOOD food but a bad ass place", "VERY good BUT bad"))
    plain = [r.valence for r in lexicon.unit_scores(units, LEX).orderBy("review_id").collect()]
    assert plain == [pytest.approx(compound(0.0)), pytest.approx(compound(2.293 - 2 - 0.9 * 0.293))]
    capitals = lexicon.unit_scores(units, replace(LEX, capitals=True)).orderBy("review_id").first()
    assert capitals.valence == pytest.approx(compound(0.733))


def test_rules_agree_for_a_joined_lexicon(spark, reviews):
    df = reviews("VERY good food but a bad ass place. The kiss of death!", None, "", "GOOD but BAD but good", "of death bad bad ass")
    table = spark.createDataFrame([("good", 2000, 700), ("bad", -2000, -600)], "token string, valence_milli int, polarity_milli int")
    inline, joined = (lexicon.rule_sentiment(df, table, FULL, max_inline=n) for n in (100, 0))
    assert rows(inline) == rows(joined)
    assert rows(inline, "valence_score") == rows(lexicon.rule_sentiment(df, FULL), "valence_score")
