"""The forest grown over coded rows: its counts and splits against brute force, and the model it gives."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opinionloom import schemas
from opinionloom.operators import forests, training


def test_splits_equal_brute_force():
    rng = np.random.default_rng(5)
    n, shape, weight = 400, (5, 6, 3), np.array([0.5, 1.0, 3.0])
    codes, classes = rng.integers(0, 6, (5, n), dtype=np.uint8), rng.integers(0, 3, n).astype(np.uint16)
    batch = pa.RecordBatch.from_pylist([{"part": 0, "seq": 7, "n": n, "codes": codes.tobytes(), "classes": classes.tobytes()}])
    # The root is split at feature 2 after code 3; only its right child is open.
    part = forests._Part(1, 0, 1, 1, np.array([[0, 3]]), [(np.array([2]), np.array([3]), np.array([-1, 0]))])
    counts = forests._count([batch], [part], shape, 9)[0]
    drawn = np.random.Generator(np.random.SFC64([9, 1, 0, 7])).integers(0, 1 << 16, n, dtype=np.uint16)
    times = forests._poisson()[drawn] * (codes[2] > 3)
    best = (-1.0, None)
    for place, feature in enumerate((0, 3)):
        for code in range(6):
            for k in range(3):
                assert counts[0, place, code, k] == times[(codes[feature] == code) & (classes == k)].sum()

        def rest(here):
            w = np.array([times[here & (classes == k)].sum() for k in range(3)]) * weight
            return w.sum() - (w**2).sum() / w.sum()

        for cut in range(5):
            left = codes[feature] <= cut
            gain = rest(left | True) - rest(left) - rest(~left)
            best = max(best, (gain, (place, cut)), key=lambda b: b[0])
    r = forests._best(counts, part.tried, np.full(5, 5), weight, 0, 1).to_pylist()[0]
    assert (r["place"], r["cut"]) == best[1] and sum(r["left"]) + sum(r["right"]) == times.sum()


def test_draws_are_poisson():
    drawn = forests._poisson()
    assert drawn.mean() == pytest.approx(1.0, abs=1e-3) and (drawn == 0).mean() == pytest.approx(math.exp(-1), abs=1e-4)


def test_a_fit_grows_whole_trees_of_rows_without_a_number_per_tree(spark, monkeypatch):
    zero = {c: F.lit(0.0) for c in schemas.FEATURES}
    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), *[v.alias(c) for c, v in zero.items()], "id")
    df = df.withColumn("rule_score", F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") + 1.0)).withColumn("rule_polarity", F.col("id") % 4 * 1.0).drop("id")
    grower = training.forest(["a", "b"], trees=4, depth=3, weighted=False)
    assert isinstance(grower.getStages()[-1], forests.Forest)
    fitted = grower.fit(df)
    nodes = [t._call_java("rootNode") for t in fitted.stages[-1].trees]
    assert all(500 < t.impurityStats().count() < 700 for t in nodes)
    while nodes:
        t = nodes.pop()
        if t.subtreeDepth():
            sides = [t.leftChild(), t.rightChild()]
            assert sum(s.impurityStats().count() for s in sides) == t.impurityStats().count() and t.gain() > 0
            nodes += sides
    assert fitted.transform(df).where("prediction != label_idx").count() < 30
    with pytest.raises(Exception, match="NaN"):
        grower.fit(df.withColumn("emotion_score", F.when(F.col("rule_score") > 1, math.nan).otherwise(0.0)))
    # The same trees when a task may hold the counts of only a few nodes.
    monkeypatch.setattr(forests, "MAX_COUNTS", 1)
    again = grower.fit(df)
    assert [t.toDebugString.split("\n", 1)[1] for t in again.stages[-1].trees] == [t.toDebugString.split("\n", 1)[1] for t in fitted.stages[-1].trees]
