"""One batch run: new reviews in, results, aspect rows, feedback and report out."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from .. import resources
from ..operators import aspects as absa
from ..operators import feedback, reporting
from ..sinks import files
from ..sinks.tables import ResultStore
from ..sources.reviews import incremental_reviews, open_table, read_reviews, unprocessed_reviews
from .analyze import Analysis, Scores, Settings, analyze_reviews, result_rows, stamped


def select_reviews(reviews: DataFrame, store: ResultStore, mode: str = "delta", limit: int | None = None) -> DataFrame:
    """delta: ids above the largest stored one; missing: every id without a result; full: all.

    Of these the first `limit` ids, if given.
    """
    if mode not in ("delta", "missing", "full"):
        raise ValueError(f"unknown mode {mode!r}: use delta, missing or full")
    if mode != "full" and not store.is_empty():
        pick = incremental_reviews if mode == "delta" else unprocessed_reviews
        reviews = pick(reviews, store.ids())
    return reviews.orderBy("review_id").limit(limit) if limit else reviews


def run_batch(
    reviews: DataFrame,
    store: ResultStore,
    scores: Scores | Callable[[DataFrame], Scores] | None = None,
    settings: Settings | None = None,
    model: tuple[PipelineModel, list[str]] | None = None,
    categories: DataFrame | None = None,
    mode: str = "delta",
    feedback_path: str | None = None,
    threshold: float = resources.LOW_CONFIDENCE,
    report_path: str | None = None,
    limit: int | None = None,
) -> Analysis:
    """Analyse the selected reviews and write everything that was asked for.

    scores may be tables, which are cut to the selected reviews unless all are, or a function that scores the selected reviews. Signals and
    details feed several outputs; they are kept on the executors for the run and released at
    its end, so what is returned is computed again if it is used. The results are written last: a run that breaks off is repeated under the same
    number, and its feedback lines and report replace the ones it left.
    """
    chosen = select_reviews(reviews, store, mode, limit)
    if callable(scores):
        scores = scores(chosen)
    elif scores is not None and (limit or mode != "full" and not store.is_empty()):
        scores = scores.cut_to(chosen)
    analysis = analyze_reviews(chosen, scores, settings, model)
    details = analysis.details.persist(StorageLevel.MEMORY_AND_DISK)
    signals = analysis.signals.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        stored_aspects = details if categories is None else absa.map_categories(details, categories)
        last = store.last_batch()
        number = 0 if last is None else last + 1
        emotions = [e.lower() for e in (settings or Settings()).emotions]
        if feedback_path:
            low = feedback.low_confidence(signals, threshold).join(chosen, "review_id")
            files.append_feedback(feedback.feedback_record(low, details, emotions), feedback_path, f"batch-{store.identity}-{number}")
        if report_path:
            blocks = reporting.review_report(signals.join(chosen, "review_id"), details, emotions, ordered=True)
            files.write_report(reporting.report_summary(signals, details, signals), blocks, report_path)
        store.write_batch(number, stamped(result_rows(signals)), stored_aspects)
    finally:
        signals.unpersist()
        details.unpersist()
    return analysis


def main(argv: list[str] | None = None) -> None:
    """spark-submit entry: python -m opinionloom.plans.batch --reviews-table PATH --results PATH"""
    parser = argparse.ArgumentParser(description="Analyse new reviews")
    parser.add_argument("--reviews-table", required=True, help="path of the review table, or its name in the catalog")
    parser.add_argument("--format", default="parquet", help="format of the path; 'table' for a catalog name")
    parser.add_argument("--id-col", default="review_id")
    parser.add_argument("--text-col", default="text")
    parser.add_argument("--results", required=True, help="folder of the result store")
    parser.add_argument("--full", action="store_true", help="analyse all reviews again")
    parser.add_argument("--limit", type=int)
    parser.add_argument("--log-feedback", metavar="FOLDER", help="log results below --conf-threshold")
    parser.add_argument("--conf-threshold", type=float, default=resources.LOW_CONFIDENCE)
    parser.add_argument("--output-file", metavar="FOLDER", help="write the report here")
    parser.add_argument("--model-dir", help="folder of published fusion models; the latest one is used")
    parser.add_argument("--categories", help="Parquet table (category_id, aspect)")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("opinionloom-batch").getOrCreate()
    table = spark.table(args.reviews_table) if args.format == "table" else open_table(spark, args.format, args.reviews_table)
    store = ResultStore(spark, args.results)
    run_batch(
        read_reviews(table, args.id_col, args.text_col),
        store,
        model=files.load_latest_model(spark, args.model_dir) if args.model_dir else None,
        categories=spark.read.parquet(args.categories) if args.categories else None,
        mode="full" if args.full else "delta",
        feedback_path=args.log_feedback,
        threshold=args.conf_threshold,
        report_path=args.output_file,
        limit=args.limit,
    )
    print(f"reviews with a result: {store.results().count()}")


if __name__ == "__main__":
    main()
