"""A text classifier trained in epochs of mini-batches, with a measure and a saved state after each.

The model is a multinomial regression over hashed words, kept by the driver (classes x features numbers). Every step is
a Spark job: tasks sum the gradient of their rows, the sums are added by feature, and the driver moves the weights
(Adagrad). Gradients are added as whole numbers, so a step gives the same bits however the rows are split or repeated.

Defined cases: rows without a label, or with one that is no class, are left out; a text that is NULL or has no word is
scored by the intercept alone; repeated rows count as often as they occur; an empty table has the measure NULL.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Gradients and losses are whole multiples of this.
_STEP = 2.0**-30
# The driver holds weights and squares of this many numbers at most (64 MB each).
MAX_NUMBERS = 1 << 23


@dataclass(frozen=True)
class Setup:
    """What has to stay the same while a training goes on; the last feature is the intercept."""

    classes: tuple[str, ...]
    n_features: int = 1 << 18
    batches: int = 8
    rate: float = 0.5
    l2: float = 1e-6
    seed: int = 42

    def __post_init__(self):
        if len(self.classes) * (self.n_features + 1) > MAX_NUMBERS:
            raise ValueError(f"classes x features exceed {MAX_NUMBERS} numbers")
        if not self.classes or self.batches < 1 or self.n_features < 1:
            raise ValueError("a training needs classes, features and batches")


@dataclass(frozen=True)
class TextModel:
    """weights(feature, class) after an epoch, and the sums of squared gradients that the next one goes on with."""

    setup: Setup
    weights: np.ndarray
    squares: np.ndarray


def start(setup: Setup) -> TextModel:
    shape = (setup.n_features + 1, len(setup.classes))
    return TextModel(setup, np.zeros(shape), np.zeros(shape))


def _features(setup: Setup):
    return F.transform(text.words("text"), lambda w: F.pmod(F.xxhash64(w), F.lit(setup.n_features)).cast("int"))


def hashed_rows(df: DataFrame, setup: Setup) -> DataFrame:
    """(review_id, class, batch, features) of df(review_id, text, label): one feature per word, its batch by a hash of the id."""
    place = F.array_position(F.array(*[F.lit(c) for c in setup.classes]), F.col("label")) - 1
    batch = F.pmod(F.xxhash64("review_id", F.lit(setup.seed)), F.lit(setup.batches)).cast("int")
    rows = df.select("review_id", place.cast("int").alias("class"), batch.alias("batch"), _features(setup).alias("features"))
    return rows.where(F.col("class") >= 0)


def _chances(features: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class probabilities of each row; and of each word its feature, row and value."""
    lengths = features.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ids = features.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lengths)), lengths)
    value = (1.0 / np.sqrt(np.maximum(lengths, 1)))[row]
    z = np.column_stack([np.bincount(row, weights=weights[ids, k] * value, minlength=len(lengths)) for k in range(weights.shape[1])])
    z = z + weights[-1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True), ids, row, value


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x / _STEP)


def gradient(rows: DataFrame, model: TextModel) -> tuple[np.ndarray, int]:
    """Sum over hashed rows of the gradient of -ln p(class), and the number of rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model.weights)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        total, n = np.zeros(weights.shape, dtype=np.int64), 0
        for b in batches:
            if b.num_rows == 0:
                continue
            p, ids, row, value = _chances(b.column("features"), weights)
            p[np.arange(b.num_rows), b.column("class").to_numpy(zero_copy_only=False)] -= 1.0
            for k in range(weights.shape[1]):
                # Whole numbers below 2^53, so that the floating sum is exact.
                total[:, k] += np.bincount(ids, weights=_whole(value * p[row, k]), minlength=len(weights)).astype(np.int64)
                total[-1, k] += int(_whole(p[:, k]).sum())
            n += b.num_rows
        where = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where[0].astype(np.int32)), pa.array(where[1].astype(np.int32)), pa.array(total[where])], ["feature", "class", "g"])
        # The number of rows travels as the sum of a feature of its own.
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64())], ["feature", "class", "g"])

    parts = rows.select("class", "features").mapInArrow(sums, "feature int, class int, g long")
    # At most one row per number of the model.
    found = parts.groupBy("feature", "class").agg(F.sum("g").alias("g")).toArrow()
    shared.unpersist()
    feature, k, g = (found.column(c).to_numpy() for c in ("feature", "class", "g"))
    out = np.zeros(model.weights.shape)
    real = feature >= 0
    out[feature[real], k[real]] = g[real] * _STEP
    return out, int(g[~real].sum())


def moved(model: TextModel, grad: np.ndarray, n: int) -> TextModel:
    """The model after one step against the mean gradient of n rows; features that did not occur stay as they are."""
    if n == 0:
        return model
    mean = grad / n
    mean = np.where(grad != 0, mean + model.setup.l2 * model.weights, 0.0)
    squares = model.squares + mean * mean
    step = np.divide(mean, np.sqrt(squares), out=np.zeros_like(mean), where=squares > 0)
    return TextModel(model.setup, model.weights - model.setup.rate * step, squares)


def measure(rows: DataFrame, model: TextModel) -> dict:
    """n, accuracy and loss (mean -ln p of the right class) over hashed rows; both NULL when there are none."""
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = _chances(b.column("features"), shared.value)[0]
                right = b.column("class").to_numpy(zero_copy_only=False)
                loss = -np.log(np.maximum(p[np.arange(len(right)), right], 1e-300))
                yield pa.RecordBatch.from_arrays([pa.array([len(right)]), pa.array([int((p.argmax(axis=1) == right).sum())]), pa.array([int(_whole(loss).sum())])], ["n", "hits", "loss"])

    r = rows.select("class", "features").mapInArrow(sums, "n long, hits long, loss long").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("loss").alias("loss")).first()
    shared.unpersist()
    return {"n": r.n or 0, "accuracy": r.hits / r.n if r.n else None, "loss": r.loss * _STEP / r.n if r.n else None}


_MEASURES = "epoch int, n long, accuracy double, loss double, setup string"


def _setup_text(setup: Setup) -> str:
    return json.dumps(vars(setup) | {"classes": list(setup.classes)}, sort_keys=True)


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """(epoch, n, accuracy, loss, setup) of the finished epochs; none when nothing was trained there."""
    try:
        return spark.read.schema(_MEASURES).parquet(f"{folder}/measures/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MEASURES)


def _save(spark: SparkSession, model: TextModel, folder: str, epoch: int, measured: dict) -> None:
    """The state first, then the measure: an epoch without its measure is repeated."""
    where = np.nonzero(model.squares)
    state = pa.table({"feature": where[0].astype(np.int32), "class": where[1].astype(np.int32), "weight": model.weights[where], "square": model.squares[where]})
    spark.createDataFrame(state).write.mode("overwrite").parquet(f"{folder}/states/epoch-{epoch}")
    row = [(epoch, measured["n"], measured["accuracy"], measured["loss"], _setup_text(model.setup))]
    spark.createDataFrame(row, _MEASURES).coalesce(1).write.mode("overwrite").parquet(f"{folder}/measures/epoch-{epoch}")


def load_epoch(spark: SparkSession, folder: str, epoch: int | None = None) -> TextModel:
    """The model after an epoch, by default the last finished one."""
    done = {r.epoch: r.setup for r in measures(spark, folder).collect()}
    epoch = max(done, default=0) if epoch is None else epoch
    if epoch not in done:
        raise ValueError(f"no finished epoch {epoch} in {folder}")
    values = json.loads(done[epoch])
    model = start(Setup(**values | {"classes": tuple(values["classes"])}))
    state = spark.read.parquet(f"{folder}/states/epoch-{epoch}").toArrow()
    at = (state.column("feature").to_numpy(), state.column("class").to_numpy())
    model.weights[at], model.squares[at] = state.column("weight").to_numpy(), state.column("square").to_numpy()
    return model


def train_epochs(train: DataFrame, test: DataFrame, setup: Setup, folder: str, epochs: int = 3) -> DataFrame:
    """Train on train(review_id, text, label) up to so many epochs and return measures() on test.

    A training that was stopped goes on after its last finished epoch; one that has as many epochs returns at once. The
    rows are hashed once into the folder, one part per mini-batch, so that a step reads only its own. A folder belongs to
    one setup and one pair of tables."""
    spark = train.sparkSession
    done = measures(spark, folder).collect()
    if any(r.setup != _setup_text(setup) for r in done):
        raise ValueError(f"{folder} holds a training with another setup")
    last = max((r.epoch for r in done), default=0)
    if last < epochs:
        model = load_epoch(spark, folder, last) if last else start(setup)
        for name, table in (("train", train), ("test", test)):
            if not last:
                hashed_rows(table, setup).write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/rows/{name}")
        schema = hashed_rows(train, setup).select("review_id", "class", "features", "batch").schema
        rows = spark.read.schema(schema).parquet(f"{folder}/rows/train")
        held = spark.read.schema(schema).parquet(f"{folder}/rows/test")
        for epoch in range(last + 1, epochs + 1):
            for b in range(setup.batches):
                model = moved(model, *gradient(rows.where(F.col("batch") == b), model))
            _save(spark, model, folder, epoch, measure(held, model))
    return measures(spark, folder)


def predict(df: DataFrame, model: TextModel) -> DataFrame:
    """df with prediction (the likeliest class, the first of equal ones) and probability."""
    shared = df.sparkSession.sparkContext.broadcast(model.weights)
    classes = np.array(model.setup.classes, dtype=object)

    @F.arrow_udf("struct<prediction: string, probability: double>")
    def best(features: pa.Array) -> pa.Array:
        p = _chances(features, shared.value)[0]
        return pa.StructArray.from_arrays([pa.array(classes[p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1))], ["prediction", "probability"])

    return df.withColumn("_p", best(_features(model.setup))).select(*[F.col(f"`{c}`") for c in df.columns], "_p.prediction", "_p.probability")
