"""Streams: the same analysis over new files, compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinionloom.operators import feedback
from opinionloom.plans import analyze
from opinionloom.session import scratch
from opinionloom.plans.batch import run_batch
from opinionloom.sinks.score_tables import KINDS, ScoreTables
from opinionloom.sinks.tables import ResultStore
from opinionloom.sources.feedback import read_feedback_log
from opinionloom.sources.id_stream import FileTable, read_id_stream
from opinionloom.streaming import reviews as streams

from . import inputs as I
from .aspect_queries import CATEGORIES, categories
from .registry import query
from .signal_queries import ANALYSIS_JOINS, FEATURE_TABLES, FEATURES_SQL, TOP_EMOTION, scores



def _stream(spark, sf_dir, table):
    schema = I.load(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


@query(f"""WITH {FEATURE_TABLES}, {FEATURES_SQL}, {TOP_EMOTION}, {CATEGORIES},
ids AS (SELECT lower(aspect) AS a, max(category_id) AS category_id FROM categories GROUP BY 1),
spans AS (SELECT review_id, string_agg(category_id || ':' || sentiment_label, ',' ORDER BY category_id, sentiment_label) AS spans
          FROM rated JOIN ids ON lower(aspect) = a GROUP BY review_id)
SELECT f.review_id, CASE s.sentiment WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS overall_sentiment,
       s.sentiment AS overall_score, emotion_label, top_emotion_score AS emotion_score, sarcasm_label,
       c.sarcasm_score AS sarcasm_score, 'neutral' AS fusion_label, 0.0::DOUBLE AS fusion_confidence, coalesce(spans, '') AS spans
FROM {ANALYSIS_JOINS} LEFT JOIN spans ON spans.review_id = f.review_id""")
def stream_reviews(spark, sf_dir):
    """Results and aspects stored by a stream of several micro-batches with scores and categories.

    Older versions of two thirds of the reviews come first; a second run of the same checkpoint brings the rest.
    """
    folder, store = scratch(spark, "stream-input"), ResultStore(spark, scratch(spark, "stream-results"))
    reviews, checkpoint = I.opinions(spark, sf_dir), scratch(spark, "stream-checkpoint")
    settings = analyze.Settings(sentiment_model=I.TWO_WAY)
    old = reviews.withColumn("text", F.lit("The old food was bad."))
    # A micro-batch is as many files as there are cores, so its texts are read by all of them.
    files = spark.sparkContext.defaultParallelism
    for parts in ([old.where("review_id % 3 <> 0")], [reviews.where("review_id % 2 = 0"), reviews.where("review_id % 2 <> 0")]):
        for part in parts:
            part.repartition(files, "review_id").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(reviews.schema).option("maxFilesPerTrigger", files).parquet(folder)
        run = streams.stream_reviews(
            stream, store, lambda batch: analyze.analyze_reviews(batch, scores(spark, sf_dir).cut_to(batch), settings), checkpoint,
            categories(spark, sf_dir),
        )
        run.awaitTermination()
    span = F.concat_ws(":", F.col("category_id").cast("string"), "aspect_sentiment")
    listed = F.array_sort(F.collect_list(F.struct("category_id", "aspect_sentiment", span.alias("s"))))
    spans = store.aspects().groupBy("review_id").agg(F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("spans"))
    return store.results().drop("created_at", "updated_at").join(spans, "review_id", "left").fillna("", subset=["spans"])


@query(f"""WITH {I.FUSED} SELECT review_id::VARCHAR AS review_id, 'order ' || review_id AS text, fused_label, fused_confidence,
fused_confidence AS rule_polarity FROM fused WHERE fused_confidence < 0.6""")
def stream_feedback(spark, sf_dir):
    """Low-confidence results of a stream, read back from the JSON log."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    confidence = (key * 37 % 101) / 100.0
    label = F.when(status == "F", "positive").when(status == "O", "negative").otherwise("neutral")
    results = _stream(spark, sf_dir, "orders").select(
        key.alias("review_id"), F.concat(F.lit("order "), key.cast("string")).alias("text"), label.alias("fused_label"),
        confidence.alias("fused_confidence"), confidence.alias("rule_polarity"),
    )
    path = scratch(spark, "stream-feedback")
    streams.stream_feedback(results, path, scratch(spark, "stream-feedback-checkpoint")).awaitTermination()
    export = feedback.feedback_to_training(read_feedback_log(spark, path))
    return export.select("review_id", "text", "fused_label", "fused_confidence", "rule_polarity")


#: Reviews in a bucket: a task joins and groups one bucket of each table, whatever the size of the tables.
BUCKET_REVIEWS = 50_000


def _score_tables(spark, sf_dir):
    """The score tables of the session in buckets; written on first use."""
    path = I.session_folder(spark, sf_dir, "score-tables")
    buckets = max(8, -(-I.load(spark, sf_dir, "orders").count() // BUCKET_REVIEWS))
    tables = ScoreTables(spark, path, "scores_" + path.rpartition("-")[2], buckets)
    if tables.scores().sentiment is None:
        made = scores(spark, sf_dir)
        for kind in KINDS:
            tables.write(kind, getattr(made, kind))
    return tables.scores()


@query(f"""WITH {FEATURE_TABLES}, {FEATURES_SQL}, {TOP_EMOTION}
SELECT f.review_id, CASE s.sentiment WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS overall_sentiment,
       s.sentiment AS overall_score, emotion_label, top_emotion_score AS emotion_score, sarcasm_label,
       c.sarcasm_score AS sarcasm_score, 'neutral' AS fusion_label, 0.0::DOUBLE AS fusion_confidence
FROM {ANALYSIS_JOINS}""")
def delta_batch(spark, sf_dir):
    """All reviews by two batch runs on bucketed score tables: most of them first, then the last hundredth as a delta."""
    reviews, store = I.opinions(spark, sf_dir), ResultStore(spark, scratch(spark, "delta-results"))
    found, settings = _score_tables(spark, sf_dir), analyze.Settings(sentiment_model=I.TWO_WAY)
    mark = reviews.agg(F.percentile_approx("review_id", 0.99, 1000)).first()[0]
    for part in (reviews.where(F.col("review_id") <= mark), reviews):
        run_batch(part, store, found, settings)
    return store.results().drop("created_at", "updated_at")


@query(f"""WITH {FEATURE_TABLES}, {FEATURES_SQL}, {TOP_EMOTION}
SELECT f.review_id, CASE s.sentiment WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END AS overall_sentiment,
       s.sentiment AS overall_score, emotion_label, c.sarcasm_score AS sarcasm_score
FROM {ANALYSIS_JOINS}""")
def stream_from_table(spark, sf_dir):
    """A table read as a stream by its ids, in two runs of one checkpoint: the table has grown in between."""
    reviews, folder, store = I.opinions(spark, sf_dir), scratch(spark, "id-table"), ResultStore(spark, scratch(spark, "id-results"))
    found, settings, checkpoint = _score_tables(spark, sf_dir), analyze.Settings(sentiment_model=I.TWO_WAY), scratch(spark, "id-checkpoint")
    mark = reviews.agg(F.percentile_approx("review_id", 0.7, 1000)).first()[0]
    for part in (reviews.where(F.col("review_id") <= mark), reviews.where(F.col("review_id") > mark)):
        part.write.mode("append").parquet(folder)
        stream = read_id_stream(spark, FileTable(folder), ids_per_task=4000)
        streams.stream_reviews(stream, store, lambda batch: analyze.analyze_reviews(batch, found.cut_to(batch), settings), checkpoint).awaitTermination()
    return store.results().select("review_id", "overall_sentiment", "overall_score", "emotion_label", "sarcasm_score")
