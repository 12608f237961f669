"""Training runs: sample data, feedback export, or a given table."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import feedback, training
from ..sinks import files
from ..sources.feedback import read_feedback_log
from ..sources.training import read_training_table, sample_training_data


@dataclass
class TrainingRun:
    """What a run produced; the feedback mode stops before training and only exports rows."""

    model_path: str | None = None
    exported: bool = False
    summary: DataFrame | None = None
    report: DataFrame | None = None
    importance: DataFrame | None = None


def train_and_publish(table: DataFrame, model_dir: str, version: str, k: int = 5, trees: int = 100,
                      id_col: str = "review_id") -> TrainingRun:
    spark = table.sparkSession
    predictions = training.cross_validate(table, k, trees, id_col=id_col).persist()
    # Both are small, a few rows per fold and class; they are taken before the predictions are released.
    summary, report = (
        spark.createDataFrame(df.collect(), df.schema)
        for df in (training.cv_summary(training.fold_accuracy(predictions)), training.classification_report(predictions, ["fold"]))
    )
    predictions.unpersist()
    model, classes = training.fit_fusion(table, trees)
    path = files.publish_model(spark, model, classes, model_dir, version)
    return TrainingRun(model_path=path, summary=summary, report=report, importance=training.feature_importance(spark, model))


def run_training(spark: SparkSession, mode: str, model_dir: str, version: str, *, n: int = 100,
                 feedback_log: str | None = None, table_path: str | None = None, export_path: str | None = None,
                 labels: DataFrame | None = None, k: int = 5, trees: int = 100) -> TrainingRun:
    """sample: train on grown rows. feedback: export the logged rows for labelling; with
    labels(review_id, label, labelled_at) join the latest label of each and train on them.
    manual: train on a labelled table."""
    if mode == "sample":
        return train_and_publish(sample_training_data(spark, n), model_dir, version, k, trees)
    if mode == "feedback":
        if not feedback_log or (labels is None and not export_path):
            raise ValueError("feedback mode needs feedback_log, and export_path or labels")
        rows = feedback.feedback_to_training(read_feedback_log(spark, feedback_log))
        if labels is not None:
            return train_and_publish(feedback.labelled_feedback(rows, labels), model_dir, version, k, trees)
        return TrainingRun(exported=files.write_training_csv(rows, export_path))
    if mode == "manual":
        if not table_path:
            raise ValueError("manual mode needs table_path, a labelled training table")
        return train_and_publish(read_training_table(spark, table_path), model_dir, version, k, trees)
    raise ValueError(f"unknown mode {mode!r}: use sample, feedback or manual")


def main(argv: list[str] | None = None) -> None:
    """spark-submit entry: python -m opinionloom.plans.train --mode sample --model-dir DIR --version v1"""
    parser = argparse.ArgumentParser(description="Train the fusion model")
    parser.add_argument("--mode", choices=["sample", "feedback", "manual"], required=True)
    parser.add_argument("--model-dir", required=True)
    parser.add_argument("--version", required=True)
    parser.add_argument("--num-samples", type=int, default=100)
    parser.add_argument("--folds", type=int, default=5)
    for name in ("--feedback-log", "--table-path", "--export-path"):
        parser.add_argument(name)
    parser.add_argument("--labels", help="Parquet table (review_id, label, labelled_at): train on the labelled feedback")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("opinionloom-train").getOrCreate()
    run = run_training(
        spark, args.mode, args.model_dir, args.version, n=args.num_samples, feedback_log=args.feedback_log,
        table_path=args.table_path, export_path=args.export_path, k=args.folds,
        labels=spark.read.parquet(args.labels) if args.labels else None,
    )
    for table in (run.summary, run.report, run.importance):
        if table is not None:
            table.show(100, truncate=False)
    print(f"model: {run.model_path}, rows exported: {run.exported}")


if __name__ == "__main__":
    main()
