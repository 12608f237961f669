"""Incremental processing: new reviews as a stream, each micro-batch analysed and stored."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import aspects as absa
from ..operators import feedback
from ..plans.analyze import Analysis, result_rows, stamped
from ..sinks.tables import ResultStore


def stream_reviews(
    reviews: DataFrame,
    store: ResultStore,
    analyze: Callable[[DataFrame], Analysis],
    checkpoint: str,
    categories: DataFrame | None = None,
    trigger: dict | None = None,
    writer: str | None = None,
) -> StreamingQuery:
    """Analyse what is new and upsert it into the store.

    The checkpoint remembers what was read, in place of the largest id. A batch that
    is replayed after a failure overwrites its own folder, so nothing is stored twice.
    The batches of a checkpoint count from 0, so each checkpoint is a writer of its own.
    """
    writer = writer or "stream-" + hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def process(batch: DataFrame, batch_id: int) -> None:
        # The source is read once: for the ids that cut the scores, the details and the results.
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        found = None
        try:
            analysis = analyze(batch)
            # Written itself and read again for the roll-up of the results.
            details = found = analysis.details.persist(StorageLevel.MEMORY_AND_DISK)
            if categories is not None:
                details = absa.map_categories(details, categories)
            store.write_batch(batch_id, stamped(result_rows(analysis.signals)), details, writer)
        finally:
            if found is not None:
                found.unpersist()
            batch.unpersist()

    started = reviews.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return started.trigger(**(trigger or {"availableNow": True})).start()


def stream_feedback(analysis: DataFrame, path: str, checkpoint: str, threshold: float | None = None,
                    trigger: dict | None = None) -> StreamingQuery:
    """Append the records of low-confidence results of a stream as JSON lines."""
    picked = feedback.low_confidence(analysis) if threshold is None else feedback.low_confidence(analysis, threshold)
    writer = feedback.feedback_record(picked).writeStream.format("json").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
