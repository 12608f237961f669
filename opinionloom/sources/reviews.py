"""Review and category sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def open_table(spark: SparkSession, fmt: str, path: str | None = None, **options) -> DataFrame:
    """Any batch source: parquet, orc, csv, json, jdbc (give partitionColumn, lowerBound,
    upperBound and numPartitions so that the read is split)."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load(path) if path else reader.load()


def read_reviews(table: DataFrame, id_col: str = "review_id", text_col: str = "text", last_id: int = 0,
                 limit: int | None = None, partitions: int = 0) -> DataFrame:
    """Two renamed columns, ids above last_id when it is positive, the first `limit` ids if given.

    A file of one row group is one task however long its texts take: `partitions` deals
    the rows of such a table out by review_id. Large tables are better left as they are read.

    Without a limit the rows are not sorted: order means nothing to the operators
    and a global sort of all texts would be the most expensive step.
    """
    reviews = table.select(F.col(id_col).alias("review_id"), F.col(text_col).alias("text"))
    if last_id > 0:
        reviews = reviews.where(F.col("review_id") > last_id)
    if limit:
        return reviews.orderBy("review_id").limit(limit)
    return reviews.repartition(partitions, "review_id") if partitions else reviews


def incremental_reviews(reviews: DataFrame, results: DataFrame, full: bool = False) -> DataFrame:
    """Reviews above the largest processed id.

    All of them when nothing was processed, or when numeric ids have no positive mark:
    then ids <= 0 are as new as any other.
    """
    if full:
        return reviews
    id_type = reviews.schema["review_id"].dataType
    high_water = results.agg(F.max("review_id").cast(id_type).alias("high_water")).scalar()
    no_mark = high_water.isNull()
    if isinstance(id_type, NumericType):
        no_mark = no_mark | (high_water <= 0)
    return reviews.where(no_mark | (F.col("review_id") > high_water))


def unprocessed_reviews(reviews: DataFrame, results: DataFrame) -> DataFrame:
    """Reviews without a result, whatever their id: nothing that failed once is lost."""
    return reviews.join(results.select("review_id"), "review_id", "left_anti")


def read_aspect_categories(table: DataFrame, industry_id: int | None = None) -> DataFrame:
    return table if industry_id is None else table.where(F.col("industry_id") == industry_id)
