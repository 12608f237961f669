"""First-on-tie maxima and bounded top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_best(value: Column, score: Column, pos: Column) -> Column:
    """Aggregate: the value with the largest score; the lowest position wins a tie."""
    return F.max_by(value, F.struct(score, -pos))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each key. Spark limits each key inside every input partition
    before the shuffle, so a hot key sends only n rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
