import json

import pytest
from pyspark.sql import functions as F

from helpers import rows
from opinionloom.operators import feedback, reporting
from opinionloom.plans import analyze, batch
from opinionloom.plans.batch import run_batch
from opinionloom.sinks import files, tables
from opinionloom.sources import reviews as source
from opinionloom.sources.feedback import parse_feedback, read_feedback_log
from opinionloom.streaming.reviews import stream_feedback, stream_reviews

RESULT = "review_id long, label string, created_at int, updated_at int"


def test_upsert_keeps_created_at_and_the_last_row(spark):
    existing = spark.createDataFrame([(1, "old", 1, 1), (2, "old", 1, 1)], RESULT)
    new = spark.createDataFrame([(2, "a", 5, 5, 0), (2, "b", 5, 5, 1), (3, "c", 6, 6, 0), (3, "d", 7, 7, 0)], RESULT + ", pos int")
    merged = tables.upsert_results(existing, new, "pos")
    assert rows(merged) == [(1, "old", 1, 1), (2, "b", 1, 5), (3, "d", 6, 7)]
    assert rows(tables.upsert_results(merged, new, "pos")) == rows(merged)


def test_replaced_aspects_may_vanish(spark):
    existing = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "review_id long, span_text string")
    new = spark.createDataFrame([(1, "x")], "review_id long, span_text string")
    ids = spark.createDataFrame([(1,), (2,), (1,)], "review_id long")
    assert rows(tables.replace_aspects(existing, new, ids)) == [(1, "x"), (3, "d")]


def test_sources(spark, reviews):
    df = reviews("a", "b", "c", "d")
    empty = spark.createDataFrame([], "review_id long")
    done = spark.createDataFrame([(2,)], "review_id long")
    assert source.read_reviews(df, last_id=0, limit=0).count() == 4
    assert rows(source.read_reviews(df, last_id=1, limit=1)) == [(2, "c")]
    assert source.incremental_reviews(df, empty).count() == 4
    assert rows(source.incremental_reviews(df, done)) == [(3, "d")]
    assert source.incremental_reviews(df, done, full=True).count() == 4
    assert rows(source.unprocessed_reviews(df, done), "review_id") == [(0,), (1,), (3,)]
    assert source.read_reviews(df.coalesce(1), partitions=6).rdd.getNumPartitions() == 6


def test_nothing_new_is_dropped_without_a_mark(spark):
    df = spark.createDataFrame([(-3, "a"), (0, "b"), (4, "c")], "review_id long, text string")
    none, low, high = (df.where(c).select("review_id") for c in ("false", "review_id < 0", "review_id > 0"))
    assert source.incremental_reviews(df, none).count() == source.incremental_reviews(df, low).count() == 3
    assert source.incremental_reviews(df, high).count() == 0
    strings = df.select(F.element_at(F.array(F.lit(""), F.lit("!a"), F.lit("b")), F.when(F.col("review_id") < 0, 1).when(F.col("review_id") == 0, 2).otherwise(3)).alias("review_id"))
    assert source.incremental_reviews(strings, strings.where("false")).count() == 3
    assert rows(source.incremental_reviews(strings, strings.where("review_id = '!a'"))) == [("b",)]


def test_ids_may_be_strings(spark):
    df = spark.createDataFrame([("u-1", "Good food."), ("u-2", None)], "review_id string, text string")
    assert rows(analyze.analyze_reviews(df).signals, "review_id", "rule_label") == [("u-1", "positive"), ("u-2", "neutral")]


def test_feedback_log_round_trip(spark, reviews, folder, tmp_path):
    texts = reviews("Great food!", "Bad food, but \"cheap\"\nnew line")
    signals = analyze.analyze_reviews(texts).signals.join(texts, "review_id")
    low = feedback.low_confidence(signals)
    assert low.count() == 2 and feedback.low_confidence(signals, 0.0).count() == 0
    for run in ("a", "b", "b"):
        files.append_feedback(feedback.feedback_record(low), folder("log"), run)
    lines = [json.loads(x) for p in (tmp_path / "log").rglob("*.json") for x in p.read_text().splitlines()]
    assert len(lines) == 4
    assert set(lines[0]) == {"timestamp", "review_id", "text", "signals"} and lines[0]["timestamp"].endswith("Z")
    assert lines[0]["signals"]["fused"] == {"fused_label": "neutral", "fused_confidence": 0.0}
    assert len(lines[0]["signals"]["signals_fed_to_fusion"]) == 13
    assert lines[0]["signals"]["sarcasm_output"]["sarcasm_score"] == 0
    read = read_feedback_log(spark, folder("log"))
    assert read.count() == 4 and sorted({r.text for r in read.collect()}) == sorted(r.text for r in texts.collect())


def test_tolerant_feedback_reading(spark):
    fed = '"signals":{"signals_fed_to_fusion":%s}}'
    lines = [
        '{"review_id":1,' + fed % '{"rule_score":1.0,"num_pos_aspects":"2","rule_polarity":"0.5"}',
        '{"review_id":"2",' + fed % '{"rule_score":"many"}',
        '{"review_id":3,' + fed % '{"unheard_of":1}',
        '{"review_id":4,"signals":{"sarcasm_output":{"sarcasm_score":1.0},"fused":7,"signals_fed_to_fusion":{"rule_score":-1}}}',
        '{"review_id":5,' + fed % "{}", '{"review_id":6,"signals":{}}', "no json", '{"review_id":7,"sig',
    ]
    got = {r.review_id: r.signals for r in parse_feedback(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert sorted(got) == ["1", "2", "3", "4"]
    assert (got["1"].signals_fed_to_fusion.rule_score, got["1"].signals_fed_to_fusion.num_pos_aspects, got["1"].signals_fed_to_fusion.rule_polarity) == (1.0, 2.0, 0.5)
    assert got["2"].signals_fed_to_fusion.rule_score is None
    assert got["4"].sarcasm_output.sarcasm_score == 1 and got["4"].fused is None


def test_report_files(spark, reviews, folder, tmp_path):
    texts = reviews("Great food! " * 30, "Bad food.", None)
    scores = analyze.Scores(aspects=spark.createDataFrame(
        [(0, "food", 0, "LABEL_2", 0.9), (1, "food", 0, "LABEL_0", 0.6)], "review_id long, aspect string, pos int, label string, score double"))
    a = analyze.analyze_reviews(texts, scores)
    blocks = reporting.review_report(a.signals.join(texts, "review_id"), a.details)
    summary = reporting.report_summary(a.signals, a.details, a.signals)
    assert "Reviews analysed: 3" in summary and any("Food" in line and "positive 50.0%" in line for line in summary)
    files.write_report(summary, blocks, folder("report"))
    page = "".join(p.read_text() for p in sorted((tmp_path / "report/reviews").glob("part-*")))
    assert [page.index(f"== Review {i} ==") for i in range(3)] == sorted(page.index(f"== Review {i} ==") for i in range(3))
    assert "[360 characters in full]" in page and "no aspects detected" in page and "low confidence" in page
    assert "Generated: 2" in "".join(p.read_text() for p in (tmp_path / "report/summary").glob("part-*"))


def test_top_aspects_break_ties_by_first_review(spark):
    df = spark.createDataFrame(
        [(1, "b", "positive", "x"), (2, "a", "negative", ""), (3, "c", "odd", "y"), (4, "c", "positive", "z" * 80), (5, "c", "neutral", "w")],
        "review_id long, aspect string, sentiment_label string, context_phrase string",
    )
    got = [tuple(r)[:5] for r in reporting.top_aspects(df, 2).collect()]
    assert got == [("c", 3, 1, 0, 2), ("b", 1, 1, 0, 0)]
    assert rows(reporting.aspect_samples(df)) == [("b", 1, 1, "x"), ("c", 1, 3, "y"), ("c", 2, 4, "z" * 50)]


def test_percentages_round_ties_to_even(spark):
    from opinionloom.functions import display

    df = spark.createDataFrame([(0.1225,), (0.125,), (1.0,), (0.0,)], "c double").select(display.confidence_bar(F.col("c"), 4).alias("b"))
    assert [r.b for r in df.collect()] == ["[░░░░] 12.2%", "[░░░░] 12.5%", "[████] 100.0%", "[░░░░] 0.0%"]


def test_stream_equals_batch_and_picks_up_new_files(spark, reviews, folder, tmp_path):
    schema = "review_id long, text string"
    reviews("Great food!", "Bad food.", None).write.parquet(folder("in"))
    store = tables.ResultStore(spark, folder("store"))

    def run():
        stream = spark.readStream.schema(schema).parquet(folder("in"))
        stream_reviews(stream, store, analyze.analyze_reviews, folder("checkpoint")).awaitTermination()

    run()
    before = {r.review_id: r.created_at for r in store.results().collect()}
    run()  # nothing new
    again = spark.createDataFrame([(1, "Lovely food."), (7, "Awful wait.")], schema)
    again.write.mode("append").parquet(folder("in"))
    run()
    latest = spark.createDataFrame([(0, "Great food!"), (1, "Lovely food."), (2, None), (7, "Awful wait.")], schema)
    expected = analyze.result_rows(analyze.analyze_reviews(latest).signals)
    got = store.results()
    assert rows(got.drop("created_at", "updated_at"), *expected.columns) == rows(expected)
    assert {r.review_id: r.created_at for r in got.collect()}[1] == before[1]
    assert store.aspects().count() == 0


def test_writers_share_a_store(spark, reviews, folder):
    """A stream after a batch run, and replays around a compaction."""
    store = tables.ResultStore(spark, folder("store"))
    run_batch(reviews("Good food", "Bad"), store)
    spark.createDataFrame([(9, "Lovely wine")], "review_id long, text string").write.parquet(folder("in"))
    stream = spark.readStream.schema("review_id long, text string").parquet(folder("in"))
    stream_reviews(stream, store, analyze.analyze_reviews, folder("checkpoint")).awaitTermination()
    assert rows(store.results(), "review_id") == [(0,), (1,), (9,)] and store.last_batch() == 0
    results = analyze.stamped(spark.createDataFrame([(1, "late")], "review_id long, fusion_label string"))
    aspects = spark.createDataFrame([(1, "late")], "review_id long, aspect string")
    store.write_batch(1, results, aspects)
    small = store.compact(folder("small"))
    small.write_batch(1, results, aspects)
    small.write_batch(0, results.where("false"), aspects.where("false"))
    assert rows(small.results(), "review_id") == [(0,), (1,), (9,)]
    assert {r.review_id: r.fusion_label for r in small.results().collect()}[1] == "late"
    assert rows(small.aspects().where("aspect = 'late'"), "review_id") == [(1,)]


def test_an_unreadable_store_is_not_taken_for_an_empty_one(spark, folder, tmp_path):
    broken = tmp_path / "store/results/place=0/writer=batch/batch=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"this is no parquet file at all")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        tables.ResultStore(spark, folder("store")).last_batch()
    assert tables.ResultStore(spark, folder("elsewhere")).last_batch() is None


def test_the_command_line_run(spark, reviews, folder):
    reviews("Good food", "Bad", None).withColumnsRenamed({"review_id": "id", "text": "body"}).write.parquet(folder("reviews"))
    args = ["--reviews-table", folder("reviews"), "--id-col", "id", "--text-col", "body", "--results", folder("store")]
    batch.main([*args, "--limit", "2", "--log-feedback", folder("log"), "--conf-threshold", "0.5", "--output-file", folder("report")])
    store = tables.ResultStore(spark, folder("store"))
    assert rows(store.results(), "review_id") == [(0,), (1,)] and read_feedback_log(spark, folder("log")).count() == 2
    batch.main(args)
    assert store.results().count() == 3
    batch.main([*args, "--full"])
    assert store.last_batch() == 2


def test_a_replayed_batch_changes_nothing(spark, folder):
    store = tables.ResultStore(spark, folder("store"))
    results = analyze.stamped(spark.createDataFrame([(1, "a"), (2, "b")], "review_id long, label string"))
    aspects = spark.createDataFrame([(1, "food"), (2, "bar")], "review_id long, span_text string")
    store.write_batch(0, results, aspects)
    store.write_batch(1, results.where("review_id = 1"), aspects.where("review_id = 5"))
    store.write_batch(1, results.where("review_id = 1"), aspects.where("review_id = 5"))
    assert rows(store.results(), "review_id", "label") == [(1, "a"), (2, "b")]
    assert rows(store.aspects()) == [(2, "bar")]
    small = store.compact(folder("compacted"))
    assert rows(small.results()) == rows(store.results()) and rows(small.aspects()) == [(2, "bar")]
    small.write_batch(2, results.where("review_id = 2"), aspects.where("review_id = 5"))
    assert small.results().count() == 2 and small.aspects().count() == 0


def test_feedback_stream(spark, folder):
    spark.range(10).select("id", (F.col("id") / 10).alias("c")).write.parquet(folder("in"))
    stream = spark.readStream.schema("id long, c double").parquet(folder("in")).select(
        F.col("id").alias("review_id"), F.lit("t").alias("text"), F.lit("neutral").alias("fused_label"), F.col("c").alias("fused_confidence")
    )
    stream_feedback(stream, folder("log"), folder("cp")).awaitTermination()
    assert spark.read.json(folder("log")).count() == 6


def test_batch_runs_pick_up_what_is_new(spark, reviews, folder, tmp_path):
    kept = set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    store = tables.ResultStore(spark, folder("store"))
    scores = analyze.Scores(aspects=spark.createDataFrame(
        [(0, "food", 0, "LABEL_2", 0.9), (3, "wine", 0, "LABEL_0", 0.6)], "review_id long, aspect string, pos int, label string, score double"))
    categories = spark.createDataFrame([(4, "Food")], "category_id int, aspect string")
    first = run_batch(reviews("Good food", "Bad", None), store, scores, categories=categories, feedback_path=folder("log"), report_path=folder("report"))
    assert first.signals.count() == 3
    assert rows(store.aspects(), "review_id", "category_id", "aspect_confidence") == [(0, 4, 0.9)]
    log = read_feedback_log(spark, folder("log"))
    assert log.count() == 3 and log.where("signals.absa_output.aspect_details LIKE '%food%'").count() >= 1
    assert set(spark.sparkContext._jsc.getPersistentRDDs().keySet()) == kept and (tmp_path / "report/summary/_SUCCESS").exists()
    more = reviews("Good food", "Bad", None, "Lovely wine")
    assert rows(run_batch(more, store, scores).signals, "review_id") == [(3,)]
    assert run_batch(more, store, scores, mode="missing").signals.count() == 0
    assert run_batch(more, store, scores, mode="full").signals.count() == 4
    assert store.results().count() == 4 and store.last_batch() == 2  # the empty run left no rows


def test_two_stores_share_a_feedback_log(spark, reviews, folder):
    for name, text in (("one", "first"), ("two", "second")):
        run_batch(reviews(text), tables.ResultStore(spark, folder(name)), feedback_path=folder("log"))
    assert sorted(r.text for r in read_feedback_log(spark, folder("log")).collect()) == ["first", "second"]


def test_results_and_aspects_break_ties_alike(spark, folder):
    store = tables.ResultStore(spark, folder("tied"))
    for writer, stamp in (("a", "2024-02-02"), ("b", "2024-01-01")):  # two writers that took one place at once
        results = spark.createDataFrame([(1, writer)], "review_id long, label string").selectExpr(
            "*", f"timestamp'{stamp}' AS created_at", f"timestamp'{stamp}' AS updated_at")
        store._write(0, writer, 0, results, results.select("review_id", "label"))
    assert [r.label for r in store.results().collect()] == ["a"] and [r.label for r in store.aspects().collect()] == ["a"]
