"""Score tables cut to the chosen reviews: same rows, and no shuffle of a whole table."""

import re

import pytest
from pyspark.sql import functions as F

from opinionloom.functions import chosen
from opinionloom.functions.chosen import bloom_filter, chosen_ids
from opinionloom.operators import scoring
from opinionloom.plans.analyze import Scores
from opinionloom.sinks.score_tables import ScoreTables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def scores(spark):
    rows = spark.range(4000).select((F.col("id") % 1000 - 10).alias("review_id"), F.lit("m").alias("model"), (F.col("id") % 4).cast("int").alias("pos"),
                                    F.concat(F.lit("LABEL_"), F.col("id") % 4).alias("label"), (F.col("id") % 7 / 7).alias("score"))
    return rows.union(rows.limit(1).selectExpr("null", "model", "pos", "label", "score"))


@pytest.mark.parametrize("max_rows", [1000, 0])
@pytest.mark.parametrize("ids", [[5, 5, -10, 989, 12345, None], [], list(range(-10, 990))])
def test_rows_of_chosen_ids(spark, scores, max_rows, ids):
    reviews = spark.createDataFrame([(i,) for i in ids], "review_id long")
    found = chosen_ids(reviews, max_rows=max_rows).rows_of(scores)
    wanted = {i for i in ids if i is not None}
    assert found.columns == scores.columns
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in scores.collect() if r.review_id in wanted)


def test_filter_lets_few_others_through(spark):
    ids = spark.range(5000).select((F.col("id") * 7919).alias("k"))
    words, bits = bloom_filter(ids, "k", 5000)
    assert bits == 1 << 16 and spark.range(1).select(F.size(words)).first()[0] == bits // 64
    chosen = chosen_ids(ids, "k", max_rows=1)
    tested = chosen.rows_of(spark.range(200_000).select((F.col("id") * 3 + 1).alias("k")))
    before_join = [x for x in plan(tested).splitlines() if "bit_get" in x]
    assert before_join and tested.count() == len({i * 7919 for i in range(5000)} & {i * 3 + 1 for i in range(200_000)})


def test_buckets_need_no_shuffle_and_are_found_again(spark, scores, folder):
    tables = ScoreTables(spark, folder("scores"), "bucketed", 4)
    tables.write("sentiment", scores)
    reviews = spark.createDataFrame([(i,) for i in range(50)], "review_id long")
    best = scoring.argmax_label(tables.scores().sentiment, ("review_id",))
    assert "Exchange" not in plan(best)
    for max_rows in (1000, 0):
        cut = scoring.argmax_label(chosen_ids(reviews, max_rows=max_rows).rows_of(tables.scores().sentiment), ("review_id",))
        scanned = re.search(r"bucketed_sentiment\[(review_id#\d+)", plan(cut))[1]
        assert "Bucketed: true" in plan(cut) and f"hashpartitioning({scanned}" not in plan(cut)
        assert cut.count() == 50
    spark.sql("DROP TABLE bucketed_sentiment")
    again = ScoreTables(spark, folder("scores"), "bucketed", 99).scores()
    assert again.aspects is None and again.sentiment.count() == scores.count()
    assert sorted(map(str, again.sentiment.collect())) == sorted(map(str, scores.collect()))
    spark.sql("DROP TABLE bucketed_sentiment")
    with pytest.raises(ValueError):
        tables.write("stars", scores)


def test_cut_to_keeps_what_is_absent(spark, scores, reviews):
    cut = Scores(sentiment=scores).cut_to(reviews("a", "b"))
    assert cut.emotions is None and {r.review_id for r in cut.sentiment.collect()} == {0, 1}
    assert Scores().cut_to(reviews("a")) == Scores()


def test_no_filter_where_its_size_would_let_most_through(spark, scores):
    ids = spark.range(50).select((F.col("id") - 20).alias("review_id"))
    cut = chosen.ChosenIds(ids, 10_000_000).rows_of(scores)
    assert chosen.bloom_filter(ids, "review_id", 10_000_000)[1] <= 1 << 23
    assert "bit_get" not in plan(cut) and "SortMergeJoin" in plan(cut)
    assert sorted(map(tuple, cut.collect())) == sorted(tuple(r) for r in scores.collect() if r.review_id is not None and -20 <= r.review_id < 30)


def test_buckets_grow_with_the_reviews(spark, folder, monkeypatch):
    from workload import stream_queries

    made = []

    class Noted(Exception):
        pass

    def note(spark, path, prefix, buckets):
        made.append(buckets)
        raise Noted

    monkeypatch.setattr(stream_queries, "ScoreTables", note)
    for rows, name in ((10, "few"), (650_000, "many")):
        spark.range(rows).write.parquet(f"{folder(name)}/orders.parquet")
        with pytest.raises(Noted):
            stream_queries._score_tables(spark, folder(name))
    assert made == [8, 13]
