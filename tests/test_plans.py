"""The physical plans are the ones that hold at scale."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from opinionloom.functions.joins import lookup_join
from opinionloom.operators import aspects as absa
from opinionloom.operators import fusion, lexicon, reporting, scoring, shaping
from opinionloom.plans import analyze
from opinionloom.sources.reviews import incremental_reviews, read_reviews

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def documents(spark):
    return read_reviews(spark.read.parquet(DOCUMENTS), "doc_id", "text")


@pytest.mark.parametrize(
    "operator",
    [
        shaping.split_sentences, shaping.tokenize, shaping.meaningful_sentences, shaping.emotion_clauses, shaping.normalize_text,
        lexicon.rule_sentiment, absa.extract_aspects, absa.prefer_plural, absa.default_overall, absa.aspect_units,
        fusion.hidden_sentiment, fusion.sarcastic_context, fusion.contradiction,
        lambda d: shaping.noun_phrases(d, {"the": shaping.ADJECTIVE, "of": shaping.NOUN}),
        lambda d: absa.aspect_context(d.withColumn("aspect", F.lit("the"))),
    ],
)
def test_text_operators_neither_shuffle_nor_leave_the_jvm(documents, operator):
    plan = plan_of(operator(documents))
    assert "Exchange" not in plan and "Python" not in plan and "Window" not in plan


def test_scans_read_only_what_is_used(documents):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan_of(lexicon.rule_sentiment(documents))
    assert "ReadSchema: struct<doc_id:bigint>" in plan_of(documents.where("review_id > 5").select("review_id"))
    assert "GreaterThan(doc_id,5)" in plan_of(documents.where("review_id > 5").select("review_id"))


def test_high_water_mark_is_a_subquery_not_a_join(spark, documents):
    plan = plan_of(incremental_reviews(documents, spark.range(5).withColumnRenamed("id", "review_id")))
    assert "BroadcastNestedLoopJoin" not in plan and "HashJoin" not in plan and "subquery" in plan.lower()


def test_argmax_reduces_before_the_shuffle(spark):
    table = spark.read.parquet(DOCUMENTS)
    scores = table.selectExpr(
        "doc_id as review_id", "cast(n_chars as int) as unit_id", "lang as model", "0 as pos", "source as label", "0.5D as score"
    )
    plan = plan_of(scoring.argmax_label(scores))
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("partial_max_by")


def test_score_arrays_need_no_shuffle_and_no_sort(spark):
    array = "array(struct('LABEL_2' as label, cast(null as double) as score), struct('LABEL_0' as label, 0.4D as score), struct('LABEL_2' as label, 0.4D as score))"
    table = spark.read.parquet(DOCUMENTS).selectExpr("doc_id as review_id", "lang as aspect", f"{array} as scores")
    for df in (scoring.argmax_label(table, ("review_id",)), absa.aspect_sentiment(table)):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Sort" not in plan and "Aggregate" not in plan
    assert {(r.label, r.score) for r in scoring.argmax_label(table, ("review_id",)).collect()} == {("LABEL_0", 0.4)}
    same = [rows(absa.aspect_sentiment(t), "review_id", "sentiment_label", "sentiment_score") for t in (table, scoring.long_scores(table))]
    assert same[0] == same[1]
    units = table.selectExpr("review_id % 7 as review_id", "cast(review_id as int) as unit_id", "scores")
    assert scoring.argmax_label(units, ("review_id",)).count() == 7


def test_samples_are_limited_before_the_shuffle(spark):
    details = spark.read.parquet(DOCUMENTS).selectExpr("doc_id as review_id", "lang as aspect", "source as context_phrase")
    plan = plan_of(reporting.aspect_samples(details))
    assert plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert ", Partial" in plan[plan.index("Exchange"):]


def test_top_k_does_not_sort_everything(spark):
    details = spark.read.parquet(DOCUMENTS).selectExpr("doc_id as review_id", "lang as aspect", "source as sentiment_label")
    assert "TakeOrderedAndProject" in plan_of(reporting.top_aspects(details))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join_for_a_hot_key(spark, how):
    # A third of the facts share one key.
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    dim = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 50, 2)]], "k string, v int")
    broadcast = lookup_join(facts, dim, ["k"], ["id"], how)
    salted = lookup_join(facts, dim, ["k"], ["id"], how, max_rows=3, salts=8)
    assert "BroadcastHashJoin" in plan_of(broadcast) and "_salt" in plan_of(salted)
    assert rows(salted) == rows(broadcast) and salted.columns == broadcast.columns


def test_salts_split_the_hot_key(spark):
    facts = spark.range(3000).select("id", F.lit("hot").alias("k"))
    salted = facts.select(F.pmod(F.xxhash64("id"), F.lit(8)).alias("s")).groupBy("s").count().collect()
    assert len(salted) == 8 and max(r["count"] for r in salted) < 3000 / 4


def test_signals_share_one_partitioning(spark, documents):
    """Without broadcasts: one shuffle of the reviews, one per score table, two for the aspect rows."""
    table = spark.read.parquet(DOCUMENTS)
    score = table.selectExpr("doc_id as review_id", "lang as model", "0 as pos", "source as label", "0.5D as score", "lang as aspect", "0 as clause_idx")
    scores = analyze.Scores(score, score, score, score)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(analyze.analyze_reviews(documents, scores).signals)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 7
    assert not any("text#" in line for line in shuffles)


def test_listed_phrases_move_sentences_once_and_places_as_numbers(spark, documents):
    listed = spark.createDataFrame([("the", shaping.ADJECTIVE), ("of", shaping.NOUN)], "token string, code int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        phrases = shaping.noun_phrases(documents, listed, max_inline=0)
        shuffles = [line for line in plan_of(phrases).splitlines() if "Exchange hashpartitioning(_key" in line]
        assert rows(phrases) == rows(shaping.noun_phrases(documents, {"the": shaping.ADJECTIVE, "of": shaping.NOUN}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(shuffles) == 2 and not any("_i#" in line for line in shuffles)
