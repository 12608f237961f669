"""Score tables kept in buckets of review_id, so that later joins and groupings by it need no shuffle."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..plans.analyze import Scores

KINDS = ("sentiment", "aspects", "emotions", "sarcasm")


class ScoreTables:
    """The four score tables below one folder, as bucketed and sorted tables of the session's catalog.

    The files name their buckets, so `scores` finds tables again that another session wrote: it declares them anew
    from what `layout` remembers. All tables have one number of buckets, so a join of several reads bucket by bucket.
    """

    def __init__(self, spark: SparkSession, path: str, prefix: str, buckets: int = 200):
        self.spark, self.path, self.prefix, self.buckets = spark, path.rstrip("/"), prefix, buckets

    def _name(self, kind: str) -> str:
        return f"{self.prefix}_{kind}"

    def write(self, kind: str, table: DataFrame) -> None:
        """Replace one table. Rows are dealt out by bucket first, so each task writes whole buckets: one file each."""
        if kind not in KINDS:
            raise ValueError(f"no score table {kind!r}: one of {', '.join(KINDS)}")
        dealt = table.repartition(self.buckets, "review_id")
        writer = dealt.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "review_id").sortBy("review_id")
        writer.option("path", f"{self.path}/{kind}").saveAsTable(self._name(kind))
        self._remember(kind, table)

    def _remember(self, kind: str, table: DataFrame) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        row = self.spark.createDataFrame([(columns, self.buckets)], "columns string, buckets int")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/layout/{kind}")

    def _declared(self, kind: str) -> DataFrame | None:
        if not self.spark.catalog.tableExists(self._name(kind)):
            try:
                layout = self.spark.read.parquet(f"{self.path}/layout/{kind}").first()
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                return None
            self.spark.sql(
                f"CREATE TABLE {self._name(kind)} ({layout['columns']}) USING parquet CLUSTERED BY (review_id) SORTED BY (review_id) "
                f"INTO {layout['buckets']} BUCKETS LOCATION '{self.path}/{kind}'"
            )
        return self.spark.table(self._name(kind))

    def scores(self) -> Scores:
        """Whatever was written; None in place of the others."""
        return Scores(**{kind: self._declared(kind) for kind in KINDS})
