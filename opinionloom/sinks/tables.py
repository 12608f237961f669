"""Result and aspect tables: merged rows, and a store that never overwrites what it reads."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "review_id"
AUDIT = ["created_at", "updated_at"]


def latest_rows(rows: DataFrame, version: Sequence[str]) -> DataFrame:
    """One row per review_id: payload and updated_at of the largest version, created_at of the smallest.

    A grouped aggregate with map-side reduction, so an id that occurs very often
    is reduced before it is shuffled. Rows of one version are told apart by their payload.
    """
    payload = [c for c in rows.columns if c not in (KEY, "created_at", *version) or c == "updated_at"]
    order = F.struct(*version, *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload) if c not in version])
    merged = rows.groupBy(KEY).agg(
        F.max_by(F.struct(*payload), order).alias("_row"), F.min_by("created_at", order).alias("created_at")
    )
    return merged.select(KEY, "_row.*", "created_at")


def upsert_results(existing: DataFrame, new: DataFrame, pos: str | None = None) -> DataFrame:
    """The table after inserting or updating `new` by review_id; an update keeps created_at.

    `new` may hold an id more than once: the last one by (updated_at, pos) wins, as
    if the rows were written one after the other.
    """
    columns = existing.columns
    place = (F.col(pos) if pos else F.lit(0)).cast("bigint").alias("_pos")
    # Only the new rows are regrouped; the table itself is joined with the ids they touch.
    reduced = latest_rows(new.select(*columns, place), ["updated_at", "_pos"]).select(*columns)
    stored = existing.select(KEY, F.col("created_at").alias("_since"))
    updated = reduced.join(stored, KEY, "left").withColumn("created_at", F.coalesce("_since", "created_at")).select(*columns)
    untouched = existing.join(reduced.select(KEY), KEY, "left_anti")
    return untouched.unionByName(updated)


def replace_aspects(existing: DataFrame, new: DataFrame, processed_ids: DataFrame) -> DataFrame:
    """Drop all aspect rows of the processed reviews, then add the new ones."""
    kept = existing.join(processed_ids.select(KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(new)


_NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class ResultStore:
    """Results and aspects as an append-only log of batches plus a view of the latest state.

    A batch belongs to a writer and has a number of that writer. Its first write gives it
    the next place in the order of the store; a replay keeps the place and replaces only
    its own folder. Writing costs as much as the batch, whatever the size of the table.
    Catalogs with MERGE can apply the same rows with one statement.
    """

    COMPACTED = "_compacted"

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        #: Tells this store from others in names of runs.
        self.identity = hashlib.md5(self.path.encode()).hexdigest()[:12]

    def _read(self, table: str) -> DataFrame | None:
        """A table of the store; None if nothing was written yet. An unreadable one raises."""
        base = f"{self.path}/{table}"
        try:
            return self.spark.read.option("basePath", base).parquet(base)
        except AnalysisException as e:
            if e.getCondition() in _NOTHING_THERE:
                return None
            raise

    def batches(self) -> DataFrame | None:
        """(place, writer, batch) of every batch, those that a compaction took up included."""
        found = [t.select("place", "writer", "batch").distinct() for t in (self._read("results"), self._read("taken")) if t is not None]
        return reduce(DataFrame.union, found).distinct() if found else None

    def write_batch(self, batch_id: int, results: DataFrame, aspects: DataFrame, writer: str = "batch") -> None:
        if writer.startswith("_") or "/" in writer:
            raise ValueError(f"no name for a writer: {writer!r}")
        known = self.batches()
        place = 0
        if known is not None:
            own = (F.col("writer") == writer) & (F.col("batch") == batch_id)
            r = known.agg(F.max(F.when(own, F.col("place"))).alias("own"), F.max("place").alias("last")).first()
            place = r.own if r.own is not None else r.last + 1
        self._write(place, writer, batch_id, results, aspects)

    def _write(self, place: int, writer: str, batch_id: int, results: DataFrame, aspects: DataFrame) -> None:
        folder = f"place={place}/writer={writer}/batch={batch_id}"
        # Aspects first: a batch exists once its results do.
        aspects.write.mode("overwrite").parquet(f"{self.path}/aspects/{folder}")
        results.write.mode("overwrite").parquet(f"{self.path}/results/{folder}")

    def last_batch(self, writer: str = "batch") -> int | None:
        """Number of the writer's newest batch; None if it has written none."""
        known = self.batches()
        return None if known is None else known.where(F.col("writer") == writer).agg(F.max("batch")).first()[0]

    def is_empty(self) -> bool:
        return self._read("results") is None

    def ids(self) -> DataFrame:
        """review_id of every stored row, repeated ones too: enough for a mark or an anti-join."""
        return self._read("results").select(KEY)

    def results(self) -> DataFrame:
        rows = self._read("results").withColumn("_writer", F.col("writer")).drop("writer", "batch")
        return latest_rows(rows, ["place", "updated_at", "_writer"])

    def aspects(self) -> DataFrame:
        """Aspect rows of the last batch that processed each review."""
        where = ["place", "writer", "batch"]
        order = F.struct("place", "updated_at", "writer", "batch")  # as in results(), where two writers took one place
        last = self._read("results").groupBy(KEY).agg(F.max(order).alias("_at")).select(KEY, *[f"_at.{c}" for c in where])
        rows = self._read("aspects")
        return rows.join(last, [KEY, *where], "left_semi").drop(*where)

    def compact(self, path: str) -> ResultStore:
        """Write the latest state as the only rows of a new store and return that store.

        They lie in a folder that no batch can address. The new store remembers the places
        of all batches it took up, so a replay of one of them stays behind the compacted state.
        """
        smaller = ResultStore(self.spark, path)
        known = self.batches()
        if known is None:
            return smaller
        known.coalesce(1).write.mode("overwrite").parquet(f"{smaller.path}/taken")
        last = known.agg(F.max("place")).first()[0]
        # One place up: a replay of the last batch taken up must not tie with it.
        smaller._write(last + 1, self.COMPACTED, 0, self.results(), self.aspects())
        return smaller
