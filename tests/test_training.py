import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import one, rows
from opinionloom import resources, schemas
from opinionloom.operators import feedback, fusion, pruning, training
from opinionloom.plans.train import run_training
from opinionloom.sinks import files
from opinionloom.sources import feedback as feedback_source
from opinionloom.sources import training as source


def test_numbers_are_cleaned(spark):
    df = spark.createDataFrame([("−1.5",), ("abc",), (None,), ("NaN",), (" 2 ",), ("1e2",)], "x string")
    assert [r.x for r in training.clean_numeric(df, ["x", "absent"]).collect()] == [-1.5, 0.0, 0.0, 0.0, 2.0, 100.0]
    assert one(training.bad_values(df, ["x"])).x == 3


def test_samples_follow_their_base_rows(spark):
    df = source.sample_training_data(spark, 500)
    assert dict(rows(df.groupBy("label").count())) == {"positive": 200, "negative": 100, "neutral": 200}
    assert df.select("review_id").distinct().count() == 500
    for name, (low, high) in resources.SAMPLE_NOISE_RANGE.items():
        r = one(df.agg(F.min(name).alias("lo"), F.max(name).alias("hi"), F.stddev(name).alias("sd")))
        assert low <= r.lo <= r.hi <= high and r.sd > 0
    again = source.sample_training_data(spark, 500).repartition(3)
    assert rows(again) == rows(df)
    assert source.sample_training_data(spark, 3).count() == 3


def test_missing_training_columns_are_named(spark):
    with pytest.raises(ValueError, match="sarcasm_score"):
        source.require_training_columns(spark.range(1).select(*[F.lit(0).alias(c) for c in schemas.FEATURES if c != "sarcasm_score"], F.lit("a").alias("label")))


def test_folds_keep_class_shares_with_one_hot_label(spark):
    df = spark.range(3000).select(F.col("id").alias("review_id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("label"))
    folded = training.stratified_folds(df, 5)
    assert folded.count() == 3000
    assert set(rows(folded.groupBy("label", "fold").count())) == {(label, f, n) for label, n in (("hot", 540), ("rare", 60)) for f in range(5)}


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    assert dict(rows(training.balanced_weights(df).distinct())) == {"a": pytest.approx(4 / 6), "b": pytest.approx(2.0)}


def test_report_equals_brute_force(spark):
    rng = random.Random(3)
    pairs = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(400)]
    got = {r["class"]: r for r in training.classification_report(spark.createDataFrame(pairs, "label string, prediction string")).collect()}
    f1s, supports = [], []
    for c in "abcd":
        tp = sum(t == p == c for t, p in pairs)
        predicted, support = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        assert (got[c].precision, got[c].recall, got[c].f1, got[c].support) == (
            pytest.approx(precision), pytest.approx(recall), pytest.approx(f1), support
        )
        f1s.append(f1)
        supports.append(support)
    assert got["macro avg"].f1 == pytest.approx(sum(f1s) / 4)
    assert got["weighted avg"].f1 == pytest.approx(sum(f * s for f, s in zip(f1s, supports)) / 400)
    assert got["accuracy"].f1 == pytest.approx(sum(t == p for t, p in pairs) / 400)


def test_forest_learns_the_samples(spark, folder):
    df = source.sample_training_data(spark, 200)
    predictions = training.cross_validate(df, k=3, trees=10, depth=5)
    assert predictions.count() == 200
    summary = one(training.cv_summary(training.fold_accuracy(predictions)))
    assert summary.mean_accuracy > 0.9
    model, classes = training.fit_fusion(df, trees=10, depth=5)
    assert classes == ["negative", "neutral", "positive"]
    importance = training.feature_importance(spark, model)
    assert importance.count() == 13 and one(importance.agg(F.sum("importance").alias("s"))).s == pytest.approx(1.0)
    files.publish_model(spark, model, classes, folder("models"), "v1")
    files.publish_model(spark, model, classes, folder("models"), "v2")
    loaded, names = files.load_latest_model(spark, folder("models"))
    fused = fusion.fuse(df.select("review_id", *schemas.FEATURES), loaded, names)
    assert fused.where("fused_confidence between 0.34 and 1.0").count() == 200


def test_rows_of_like_features_are_fitted_together(spark, monkeypatch):
    seen, fit = [], training.Pipeline.fit
    monkeypatch.setattr(training.Pipeline, "fit", lambda self, df: seen.append(df) or fit(self, df))
    df = source.sample_training_data(spark, 60).repartition(3, "review_id")
    training.fit_fusion(df, trees=2, depth=3)
    features = [tuple(r[f] for f in schemas.FEATURES) for r in df.collect()]
    parts = seen[0].select(F.spark_partition_id().alias("part"), *schemas.FEATURES).collect()
    in_parts = [[tuple(r)[1:] for r in parts if r.part == k] for k in sorted({r.part for r in parts})]
    assert all(p == sorted(p) for p in in_parts) and sorted(x for p in in_parts for x in p) == sorted(features)


def test_small_nodes_answer_as_leaves(spark):
    df = source.sample_training_data(spark, 300)
    fitted = training.forest(["negative", "neutral", "positive"], trees=4, depth=8, weighted=False).fit(df.withColumn("label", F.element_at(
        F.array(F.lit("negative"), F.lit("neutral"), F.lit("positive")), (F.crc32(F.col("review_id").cast("string")) % 3 + 1).cast("int"))))
    grown, ready = fitted.stages[-1], fitted.stages[0].transform(df)
    closed = pruning.with_least_split(grown, 12)

    def walk(node, x, least):
        """Class shares at the end of the path, which stops at the first node below `least` rows."""
        while node.subtreeDepth() > 0 and node.impurityStats().count() >= least:
            node = node.leftChild() if node.split().shouldGoLeft(x) else node.rightChild()
        stats = list(node.impurityStats().stats())
        return [s / sum(stats) for s in stats]

    got = {r.review_id: r for r in closed.transform(ready).select("review_id", "features", "probability").collect()}
    before = {r.review_id: r.probability.toArray() for r in grown.transform(ready).select("review_id", "probability").collect()}
    assert any(abs(before[i] - r.probability.toArray()).max() > 1e-6 for i, r in got.items())
    tops = [t._call_java("rootNode") for t in grown.trees]
    from pyspark.ml.common import _py2java

    for i in sorted(got)[:60]:
        x = _py2java(spark.sparkContext, got[i].features)
        want = [sum(p) / len(tops) for p in zip(*(walk(t, x, 12) for t in tops))]
        assert got[i].probability.toArray() == pytest.approx(want)
    assert pruning.with_least_split(grown, 1) is grown
    assert closed.featureImportances.toArray().sum() == pytest.approx(1.0)


def test_quantile_codes_keep_the_order(spark):
    df = spark.createDataFrame([(i, float(i * i), 5.0, None if i == 3 else float(i % 2)) for i in range(200)], "id int, a double, b double, c double")
    got = sorted(training.quantile_codes(df, ["a", "b", "c"]).select("id", "features").collect())
    codes = [r.features.toArray() for r in got]
    assert [c[0] for c in codes] == sorted(c[0] for c in codes) and 25 <= len({c[0] for c in codes}) <= training.BINS
    assert len({c[1] for c in codes}) == 1 and len({c[2] for c in codes}) == 3


def test_folds_have_their_sizes_at_any_number_of_threads(spark):
    df = source.sample_training_data(spark, 90)
    one_by_one, together = (training.cross_validate(df, k=3, trees=3, depth=3, concurrent=n) for n in (1, 3))
    assert rows(one_by_one) == rows(together)
    sizes = training.stratified_folds(df.select("review_id", "label"), 3).groupBy("fold", "label").count()
    assert rows(together.groupBy("fold", "label").count()) == rows(sizes)
    assert training.cross_validate(df.limit(0), k=3).count() == 0
    with pytest.raises(ValueError, match="none to learn"):
        training.cross_validate(df.limit(1), k=3)


def test_text_classifier_is_measured_on_held_out_rows(spark):
    df = spark.range(400).select(
        F.col("id").alias("review_id"), F.when(F.col("id") % 2 == 0, "good lovely food").otherwise("bad awful place").alias("text"),
        F.when(F.col("id") % 2 == 0, "pos").otherwise("neg").alias("label"),
    )
    _, classes, predictions = training.train_text_classifier(df, n_features=1 << 10, iterations=5)
    assert classes == ["neg", "pos"] and 40 < predictions.count() < 130
    assert predictions.where("label = prediction").count() == predictions.count()


def test_training_modes(spark, folder, tmp_path):
    run = run_training(spark, "sample", folder("models"), "v1", n=60, k=2, trees=5)
    assert run.model_path.endswith("fusion_v1") and one(run.summary).mean_accuracy > 0.5
    with pytest.raises(ValueError, match="table_path"):
        run_training(spark, "manual", folder("models"), "v1")
    with pytest.raises(ValueError, match="unknown mode"):
        run_training(spark, "other", folder("models"), "v1")
    source.sample_training_data(spark, 60).write.option("header", True).csv(folder("table"))
    assert run_training(spark, "manual", folder("models"), "v2", table_path=folder("table"), k=2, trees=5).model_path.endswith("v2")
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.jsonl").write_text("\n".join(
        ['{"review_id": %d, "text": "t", "signals": {"fused": {"fused_label": "positive", "fused_confidence": 0.4}, '
         '"signals_fed_to_fusion": {"rule_score": 1}}}' % i for i in range(9)] + ["{broken", '{"review_id": 3, "signals": {}}']
    ))
    assert not run_training(spark, "feedback", "", "", feedback_log=f"file://{log}", export_path=folder("export")).exported
    (log / "b.jsonl").write_text('{"review_id": "uuid", "signals": {"signals_fed_to_fusion": {"rule_polarity": -0.5}}}\n')
    assert run_training(spark, "feedback", "", "", feedback_log=f"file://{log}", export_path=folder("export")).exported
    rows_back = spark.read.option("header", True).csv(folder("export"))
    assert rows_back.columns == schemas.TRAINING_EXPORT and rows_back.count() == 10
    odd = rows_back.where("review_id = 'uuid'").first()
    assert (odd.rule_polarity, odd.fused_label, odd.fused_confidence) == ("-0.5", "neutral", "0.0")
    records = feedback_source.read_feedback_log(spark, f"file://{log}")
    assert Counter(r.fused_label for r in feedback.feedback_to_training(records).collect()) == {"positive": 9, "neutral": 1}


def test_a_training_run_releases_what_it_cached(spark, folder):
    cached = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = cached()
    run = run_training(spark, "sample", folder("models"), "v1", n=40, k=2, trees=2)
    assert cached() <= before and run.report.where("class = 'accuracy'").count() == 2


def test_latest_human_label_wins(spark):
    export = spark.createDataFrame([(1, ""), (2, "")], "review_id int, label string")
    labels = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1)], "review_id int, label string, labelled_at int")
    assert rows(feedback.labelled_feedback(export, labels)) == [(1, "b")]


def test_csv_with_doubled_quotes(spark, folder, tmp_path):
    names = ",".join(schemas.FEATURES)
    numbers = ",".join(["0.5"] * 13)
    (tmp_path / "table.csv").write_text(f'text,{names},label\n"He said ""great"", then\nleft",{numbers},positive\n')
    got = source.read_training_table(spark, folder("table.csv")).collect()
    assert [(r.text, r.label, r.rule_score) for r in got] == [('He said "great", then\nleft', "positive", 0.5)]
    export = spark.createDataFrame([('a "b", c\nd', *[0.5] * 13, "neutral")] * 10, ", ".join(["text string", *[f"{f} double" for f in schemas.FEATURES], "label string"]))
    assert files.write_training_csv(export, folder("export"))
    assert {r.text for r in source.read_training_table(spark, folder("export")).collect()} == {'a "b", c\nd'}


def test_unlabelled_rows_are_named_or_left_out(spark):
    table = source.sample_training_data(spark, 30).withColumn("label", F.when(F.col("rule_score") > 5, "x").otherwise(F.col("label")))
    holes = table.union(table.limit(2).withColumn("label", F.lit(None).cast("string")))
    with pytest.raises(ValueError, match="2 rows have no label"):
        training.fit_fusion(holes, trees=2, depth=2)
    model, classes = training.fit_fusion(holes, trees=2, depth=2, unlabelled="drop")
    assert None not in classes and len(classes) > 1
    weights = training.balanced_weights(holes).collect()
    assert len(weights) == 32 and all(r.weight == 1.0 for r in weights if r.label is None)
