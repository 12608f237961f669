import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import rows
from opinionloom.functions import text
from opinionloom.operators import shaping


def test_sentences_of_edge_texts(reviews):
    df = reviews("One here. Two!  Three?\nFour", None, "  　 ", "no end", "Café… é. 👍 ok")
    got = rows(shaping.split_sentences(df))
    assert got == [
        (0, 0, "One here."), (0, 1, "Two!"), (0, 2, "Three?"), (0, 3, "Four"), (3, 0, "no end"),
        (4, 0, "Café… é."), (4, 1, "👍 ok"),
    ]


def test_long_text_is_processed_whole(reviews):
    words = " ".join(f"word{i}" for i in range(20_000)) + ". End here."
    tokens = shaping.tokenize(reviews(words))
    assert tokens.count() == 20_000 + 1 + 3


def test_tokens_and_flags(reviews):
    got = {r.token: r for r in shaping.tokenize(reviews("I don't like the 2 soups, $5!")).collect()}
    assert list(got) == ["I", "don't", "like", "the", "2", "soups", ",", "$", "5", "!"]
    assert got["soups"].is_alpha and not got["don't"].is_alpha and not got["2"].is_alpha
    assert got["the"].is_stop and got[","].is_punct and not got["$"].is_punct


def test_units_fall_back_to_the_whole_text(reviews):
    got = rows(shaping.meaningful_sentences(reviews("Meh. Bad.", "Good food. Ok.", "", None)))
    assert got == [(0, 0, "Meh. Bad."), (1, 0, "Good food."), (2, 0, ""), (3, 0, "")]


def test_emotion_clauses(reviews):
    df = reviews("Nice, but slow, but cheap food", "Ok. Bad.", "short", " ", "The food was fine, but I left", None)
    assert rows(shaping.emotion_clauses(df)) == [
        (0, 0, "slow, but cheap food"),
        (1, 0, "Ok."), (1, 1, "Bad."),
        (2, 0, "short"),
        (4, 0, "The food was fine"), (4, 1, "I left"),
    ]


def test_contrast_clauses(spark):
    df = spark.createDataFrame(
        [
            (1, "The food was amazing but the food was also too salty.", "food"),
            (2, "The food was great, but the music was too loud.", "food"),
            (3, "The service was slow, but the decor was nice.", "food"),
            (4, "The service was excellent.", "service"),
        ],
        "review_id int, text string, aspect string",
    )
    assert rows(shaping.contrast_clauses(df), "review_id", "clause_idx", "clause") == [
        (1, 0, "The food was amazing"), (1, 1, "the food was also too salty."),
        (2, 0, "The food was great"), (3, 0, None), (4, 0, "The service was excellent."),
    ]


def test_noun_phrases_are_all_spans(reviews):
    pos = {"big": shaping.ADJECTIVE, "red": shaping.ADJECTIVE, "table": shaping.NOUN, "top": shaping.NOUN}
    got = rows(shaping.noun_phrases(reviews("A big red table top fell. Red."), pos), "phrase", "is_chunk")
    assert got == [
        ("big red table", False), ("big red table top", True), ("red table", False), ("red table top", False),
        ("table", False), ("table top", False), ("top", False),
    ]


def _plain_spans(toks, pos, max_words):
    """Every span tried by itself."""
    codes = ["JN"[pos[t] - 1] if t in pos else "x" for t in toks]
    right = re.compile("J*N+")
    spans = {(i, j) for i in range(len(toks)) for j in range(i + 1, len(toks) + 1) if right.fullmatch("".join(codes[i:j]))}
    whole = {(i, j) for i, j in spans if not any((a, b) != (i, j) and a <= i and j <= b for a, b in spans)}
    return sorted((i, j - i, " ".join(toks[i:j]), (i, j) in whole) for i, j in spans if max_words is None or j - i <= max_words)


@pytest.mark.parametrize("max_words", [None, 1, 3])
def test_spans_equal_those_tried_one_by_one(spark, max_words):
    pos = {"a": shaping.ADJECTIVE, "b": shaping.ADJECTIVE, "n": shaping.NOUN, "m": shaping.NOUN}
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abnmxy", k=rng.randint(1, 14))) for _ in range(60)] + ["a a a", "n", "x", "n a n a a n n", "x x n"]
    rows_in = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (99, None), (98, "")]
    df = spark.createDataFrame(rows_in, "review_id int, text string")
    want = sorted(((i, *s) for i, t in rows_in if t for s in _plain_spans(t.split(), pos, max_words)), key=str)
    table = spark.createDataFrame([*pos.items(), ("n", 9), (None, 1)], "token string, code int")
    for given, inline in ((pos, 100), (table, 100), (table, 0)):
        got = shaping.noun_phrases(df, given, max_words, inline)
        assert sorted([(r.review_id, r.tok_idx, r.n_words, r.phrase, r.is_chunk) for r in got.collect()], key=str) == want


def test_spans_of_a_long_run_take_linear_time(spark):
    def seconds(n):
        df = spark.createDataFrame([(0, "n " * n)], "review_id int, text string")
        phrases = shaping.noun_phrases(df, {"n": shaping.NOUN}, max_words=1)
        best = []
        for _ in range(3):
            start = time.perf_counter()
            assert phrases.count() == n
            best.append(time.perf_counter() - start)
        return min(best)

    seconds(1000)
    assert seconds(64_000) < 8 * max(seconds(16_000), 0.2)  # squared time would be 16-fold


def test_a_dictionary_beyond_the_inline_limit_is_joined(spark):
    table = spark.range(60_000).select(F.concat(F.lit("w"), "id").alias("token"), (F.col("id") % 2 + 1).cast("int").alias("code"))
    df = spark.createDataFrame([(1, "W0 w1 w59999 other w2")], "review_id int, text string")
    got = rows(shaping.noun_phrases(df, table), "phrase", "is_chunk")
    assert got == [("w0 w1", False), ("w0 w1 w59999", True), ("w1", False), ("w1 w59999", False), ("w59999", False)]


def test_annotated_tokens_keep_unknown_words(spark, reviews):
    lexicon = spark.createDataFrame([("soups", "soup", "NOUN", "NNS")], "token string, lemma string, pos string, tag string")
    got = rows(shaping.annotate_tokens(shaping.tokenize(reviews("Soups here")), lexicon), "token", "lemma", "pos", "tag")
    assert got == [("Soups", "soup", "NOUN", "NNS"), ("here", "here", "X", "")]


def test_trailing_punctuation(reviews):
    got = rows(shaping.strip_punct(reviews("  great!?!. ", "a . ", "...", "mid.dle")))
    assert got == [(0, "great"), (1, "a"), (2, ""), (3, "mid.dle")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.!?\n but", max_size=30), min_size=1, max_size=8))
def test_sentences_keep_every_visible_character(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, text string")
    got = df.select("review_id", F.array_join(text.sentences("text"), "").alias("s")).collect()
    squeeze = lambda s: "".join(s.split())
    assert all(squeeze(r.s) == squeeze(texts[r.review_id]) for r in got)
