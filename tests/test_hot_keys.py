"""Joins whose keys are measured before they are dealt out."""

import pytest
from pyspark.sql import functions as F

from helpers import rows
from opinionloom.functions.joins import hot_keys, lookup_join
from opinionloom.operators import scoring


@pytest.fixture
def facts(spark):
    # Half of the rows share one key, a tenth has none, the rest are 400 keys.
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 != 1, F.concat(F.lit("k"), F.col("id") % 400))
    return spark.range(20000).select("id", key.alias("k"))


@pytest.fixture
def dim(spark):
    return spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(400)]], "k string, v int")


def test_only_hot_keys_are_found_with_their_width(spark, facts):
    key = spark.createDataFrame([("hot",), (None,)], "k string").select(F.xxhash64("k").alias("h")).collect()
    found = dict(hot_keys(facts, ["k"], 16))
    assert found == {key[0].h: 8, key[1].h: 2}
    assert hot_keys(facts.limit(0), ["k"], 16) == [] and hot_keys(facts.where("k <> 'hot'"), ["k"], 4) == []


def test_cold_dimension_rows_are_not_copied(spark, facts, dim):
    joined = lookup_join(facts, dim, ["k"], ["id"], "left", max_rows=3, salts=16)
    plan = joined._jdf.queryExecution().optimizedPlan()
    assert rows(joined) == rows(facts.join(dim, "k", "left").select("id", "k", "v"))
    copies = spark.createDataFrame(hot_keys(facts, ["k"], 16), "h long, w int")
    seen = dim.withColumn("h", F.xxhash64("k")).join(copies, "h", "left").agg(F.sum(F.coalesce("w", F.lit(1)))).first()[0]
    assert seen == 400 + 8 and "_salt" in plan.toString()


def test_labels_of_a_hot_class_are_shared_by_tasks(spark):
    best = spark.range(12000).select(
        F.col("id").alias("review_id"), F.lit("m").alias("model"),
        F.when(F.col("id") % 2 == 0, "LABEL_0").when(F.col("id") % 3 == 0, "positive").otherwise(F.concat(F.lit("LABEL_"), F.col("id") % 60)).alias("label"), F.lit(0.5).alias("score"))
    names = spark.createDataFrame([("m", i, f"c{i}") for i in range(50)], "model string, idx int, label string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        shuffled = scoring.normalize_labels(best, names, max_rows=3)
        sizes = shuffled.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in sizes) < 12000 / 4
        assert rows(shuffled) == rows(scoring.normalize_labels(best, names))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_empty_sides(facts, dim, how):
    one = dim.union(dim.where("k = 'hot'"))
    assert rows(lookup_join(facts.limit(0), dim, ["k"], ["id"], how, max_rows=3)) == []
    got = lookup_join(facts, one, ["k"], ["id"], how, max_rows=3, salts=8)
    assert got.count() == facts.join(one, "k", how).count()
