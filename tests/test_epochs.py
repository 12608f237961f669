"""Epochs of mini-batches: gradient against a dense sum, same bits on any split, resuming, stated cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import one, rows
from opinionloom.operators import epochs

SETUP = epochs.Setup(("bad", "good"), n_features=64, batches=3)


@pytest.fixture
def table(spark):
    words = F.when(F.col("id") % 2 == 0, "fine tasty soup").otherwise("cold stale soup")
    return spark.range(240).select(F.col("id").alias("review_id"), F.concat_ws(" ", words, F.concat(F.lit("w"), F.col("id") % 7)).alias("text"),
                                   F.when(F.col("id") % 2 == 0, "good").otherwise("bad").alias("label"))


def test_gradient_equals_the_dense_sum(table):
    hashed = epochs.hashed_rows(table, SETUP)
    noise = np.random.default_rng(1).normal(size=(65, 2))
    model = epochs.TextModel(SETUP, noise, np.zeros_like(noise))
    got, n = epochs.gradient(hashed, model)
    want = np.zeros_like(noise)
    for r in hashed.collect():
        x = np.zeros(65)
        np.add.at(x, r.features, 1 / np.sqrt(len(r.features)))
        x[64] = 1
        z = x @ noise
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        p[r["class"]] -= 1
        want += np.outer(x, p)
    assert n == 240 and np.allclose(got, want, atol=1e-6)
    # A difference quotient of the loss agrees too.
    loss = lambda w: epochs.measure(hashed, epochs.TextModel(SETUP, w, w))["loss"] * 240
    nudge = np.zeros_like(noise)
    nudge[64, 1] = 1e-3
    assert abs((loss(noise + nudge) - loss(noise - nudge)) / 2e-3 - got[64, 1]) < 1e-2


def test_a_step_gives_the_same_bits_on_any_split(table):
    hashed = epochs.hashed_rows(table, SETUP)
    model = epochs.moved(epochs.start(SETUP), *epochs.gradient(hashed, epochs.start(SETUP)))
    sums = [epochs.gradient(hashed.repartition(k), model)[0].tobytes() for k in (1, 7)]
    assert sums[0] == sums[1]


def test_a_stopped_training_goes_on_where_it_was(spark, table, folder):
    train, test = table.where("review_id % 5 > 0"), table.where("review_id % 5 = 0")
    whole = epochs.train_epochs(train, test, SETUP, folder("whole"), 3)
    assert epochs.train_epochs(train, test, SETUP, folder("parts"), 1).count() == 1
    parts = epochs.train_epochs(train, test, SETUP, folder("parts"), 3)
    assert rows(parts) == rows(whole) and [r.epoch for r in whole.orderBy("epoch").collect()] == [1, 2, 3]
    a, b = epochs.load_epoch(spark, folder("whole")), epochs.load_epoch(spark, folder("parts"))
    assert a.weights.tobytes() == b.weights.tobytes() and a.squares.tobytes() == b.squares.tobytes()
    assert whole.where("epoch = 3").first().accuracy == 1.0 and whole.where("epoch = 3").first().loss < whole.where("epoch = 1").first().loss
    got = epochs.predict(test.withColumn("a.b", F.lit(1)), a)
    assert got.where("prediction = label AND probability > 0.5").count() == 48 and "a.b" in got.columns
    with pytest.raises(ValueError, match="another setup"):
        epochs.train_epochs(train, test, epochs.Setup(("bad", "good"), 64, 4), folder("whole"), 4)


def test_an_epoch_without_its_measure_is_repeated(spark, table, folder):
    import shutil
    epochs.train_epochs(table, table, SETUP, folder("run"), 2)
    want = epochs.load_epoch(spark, folder("run"))
    shutil.rmtree(folder("run/measures/epoch-2").removeprefix("file://"))
    epochs.train_epochs(table, table, SETUP, folder("run"), 2)
    assert epochs.load_epoch(spark, folder("run")).weights.tobytes() == want.weights.tobytes()


def test_nulls_other_labels_long_texts_and_empty_tables(spark, folder):
    odd = spark.createDataFrame([(1, None, "good"), (None, "", "bad"), (3, "soup", None), (4, "soup", "else"), (5, "wine " * 100_000, "good"), (5, "wine", "good")], "review_id long, text string, label string")
    hashed = epochs.hashed_rows(odd, SETUP)
    assert epochs.gradient(hashed, epochs.start(SETUP))[1] == 4
    assert epochs.predict(odd, epochs.start(SETUP)).where("prediction = 'bad' AND probability = 0.5").count() == 6
    r = one(epochs.train_epochs(odd.limit(0), odd.limit(0), SETUP, folder("none"), 1))
    assert (r.n, r.accuracy, r.loss) == (0, None, None)
    with pytest.raises(ValueError, match="no finished epoch"):
        epochs.load_epoch(spark, folder("nowhere"))
