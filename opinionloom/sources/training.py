"""Training tables: read from CSV, or grown from five base rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import resources, schemas
from ..operators.training import clean_numeric
from ..session import digest, gaussian, uuid_of


def require_training_columns(table: DataFrame) -> DataFrame:
    missing = [c for c in ["label", *schemas.FEATURES] if c not in table.columns]
    if missing:
        raise ValueError(f"training table lacks the columns {missing}")
    return table


def read_training_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV table with a header and doubled quotes inside quoted fields.

    multi_line: fields may hold line breaks, which makes every file one task. Without it
    large files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return clean_numeric(require_training_columns(reader.csv(path)), schemas.FEATURES)


def expand_samples(ids: DataFrame, seed: int = 42) -> DataFrame:
    """ids(i) -> one noisy copy of base row i % 5 per id.

    Noise and ids are functions of (i, seed), so a lost task gives the same rows again.
    """
    i = F.col("i")
    base = F.array(
        *[
            F.struct(
                *[F.lit(float(v)).alias(f) for f, v in zip(schemas.FEATURES, values, strict=True)],
                F.lit(label).alias("label"),
            )
            for _, values, label in resources.SAMPLE_ROWS
        ]
    )
    picked = ids.select(i, F.element_at(base, (i % len(resources.SAMPLE_ROWS)).cast("int") + 1).alias("base"))

    def feature(name: str):
        value = F.col(f"base.{name}")
        if name not in resources.SAMPLE_NOISE_RANGE:
            return value.alias(name)
        sigma = 0.1 if "confidence" in name or "distribution" in name else 0.05
        low, high = resources.SAMPLE_NOISE_RANGE[name]
        noisy = value + gaussian(digest(i, name, seed), sigma)
        return F.least(F.greatest(noisy, F.lit(float(low))), F.lit(float(high))).alias(name)

    review_id = uuid_of(digest(i, "id", seed))
    return picked.select(
        review_id.alias("review_id"),
        F.concat(F.lit("Generated sample review "), review_id).alias("text"),
        *[feature(f) for f in schemas.FEATURES],
        F.col("base.label").alias("label"),
    )


def sample_training_data(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    if n > len(resources.SAMPLE_ROWS):
        return expand_samples(spark.range(n).withColumnRenamed("id", "i"), seed)
    columns = ", ".join(["text string", *[f"{f} double" for f in schemas.FEATURES], "label string"])
    rows = [(text, *map(float, values), label) for text, values, label in resources.SAMPLE_ROWS[:n]]
    plain = spark.createDataFrame(rows, columns)
    return plain.select(uuid_of(digest(F.col("text"), seed)).alias("review_id"), *plain.columns)
