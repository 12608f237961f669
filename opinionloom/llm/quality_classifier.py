"""Quality by kernel ridge on random Fourier features of document statistics, calibrated by isotonic regression.

One pass over the texts gives each document a few statistics. Random Fourier features of the standardised
statistics approximate a Gaussian kernel; every partition of labelled rows sums its part of the normal equations, Spark
adds the parts, and the driver solves a system of fixed size. Scores of labelled rows are averaged in bins, and
pooling adjacent violators makes the bins monotone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, list_array, prefix_hashes, remainder, span_hashes, stored, stream, text_blocks, words

FEATURES = 256
#: Width of the kernel in standard deviations of a statistic, and the weight of the ridge per labelled row.
WIDTH = 4.0
RIDGE = 1e-3
BINS = 200

_KINDS = np.zeros((7, 256), bool)
_KINDS[0, 65:91] = True  # capitals
_KINDS[1, 48:58] = True  # digits
_KINDS[2, [ord(c) for c in ".,;:!?"]] = True
_KINDS[3, [ord(c) for c in "#*$%&|<>{}[]\\=_~^@/"]] = True
_KINDS[4, 10] = True  # line ends
_KINDS[5] = SPACE
_KINDS[6, 128:192] = True  # continuation bytes

NAMES = (
    "log_words", "word_length", "long_words", "distinct_words", "repeated_pairs", "capitals", "digits", "stops", "symbols",
    "symbol_words", "lines", "distinct_lines", "short_lines", "blanks", "words_per_stop", "log_bytes",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES per text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    size = np.diff(offsets)
    nonempty = np.flatnonzero(size)
    kinds = np.zeros((7, n))
    for k in range(7):
        kinds[k, nonempty] = np.add.reduceat(_KINDS[k][data].astype(np.int64), offsets[nonempty])
    capitals, digits, stops, symbols, breaks, blanks, rest = kinds
    chars = np.maximum(size - rest, 1)
    starts, ends, owner = words(data, offsets)
    count = np.bincount(owner, minlength=n)
    some = np.maximum(count, 1)
    length = ends - starts
    hashes = span_hashes(prefix_hashes(LOWER[data]), starts, ends)

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        return np.bincount(of[new], minlength=n)

    pairs = owner[1:] == owner[:-1]
    pair_of = owner[1:][pairs]
    pair = (hashes[1:] * np.uint64(3) + hashes[:-1])[pairs]
    pair_count = np.bincount(pair_of, minlength=n)
    line_ends = np.zeros(len(data), bool)
    line_ends[np.flatnonzero(data == 10)] = True
    line_starts = np.unique(np.concatenate([offsets[nonempty], np.flatnonzero(line_ends) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_owner = np.searchsorted(offsets, line_starts, "right") - 1
    line_stop = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_owner + 1])
    lines = np.bincount(line_owner, minlength=n)
    line_hash = span_hashes(prefix_hashes(data), line_starts, line_stop)
    symbol_sum = np.concatenate([[0], np.cumsum(_KINDS[3][data])])
    symbol_word = symbol_sum[ends] > symbol_sum[starts]
    some_lines = np.maximum(lines, 1)
    out[:] = np.stack(
        [
            np.log1p(count), np.bincount(owner, length, minlength=n) / some, np.bincount(owner, length > 12, minlength=n) / some,
            distinct(hashes, owner) / some, 1 - distinct(pair, pair_of) / np.maximum(pair_count, 1) * (pair_count > 0), capitals / chars, digits / chars, stops / chars,
            symbols / chars, np.bincount(owner, symbol_word, minlength=n) / some, breaks / some, distinct(line_hash, line_owner) / some_lines,
            np.bincount(line_owner, line_stop - line_starts < 40, minlength=n) / some_lines, blanks / chars, np.log1p(count / (stops + 1)), np.log1p(size),
        ],
        axis=1,
    )
    return out


def _measuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), list_array(list(statistics(data, offsets)), pa.float64())], names=["doc_id", "stats"]
            )


class Fourier:
    """Fixed random directions and phases."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray):
        self.centre, self.spread = centre, np.where(spread > 1e-12, spread, 1.0)
        u = (stream(19, 2 * len(NAMES) * FEATURES + FEATURES) >> np.uint64(11)).astype(float) / 2**53
        half = len(NAMES) * FEATURES
        self.directions = (np.sqrt(-2 * np.log(1 - u[:half])) * np.cos(2 * np.pi * u[half : 2 * half])).reshape(len(NAMES), FEATURES) / WIDTH
        self.phases = 2 * np.pi * u[2 * half :]

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        scaled = np.clip((stats - self.centre) / self.spread, -5, 5)
        waves = np.cos(scaled @ self.directions + self.phases) * np.sqrt(2 / FEATURES)
        return np.concatenate([waves, np.ones((len(stats), 1))], axis=1)


def _summing(fourier: Fourier):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = fourier(np.array(batch.column(0).to_pylist(), float).reshape(-1, len(NAMES)))
            y = batch.column(1).to_numpy().astype(float)
            total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), list_array(list(total), pa.float64())], names=["line", "sums"])

    return add


def _raw(fourier: Fourier, weights: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fourier(stats) @ weights)], names=["doc_id", "raw"])

    return score


def pooled(values: list[float], weights: list[float]) -> list[float]:
    """Weighted non-decreasing least squares by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return [v for v, _, n in blocks for _ in range(int(n))]


def quality(docs: DataFrame, labels: DataFrame, taught: Column | None = None) -> DataFrame:
    """doc_id, score for every row of `docs`; labels: doc_id, label.

    Null and empty texts have zero statistics and are scored like any other. Without labelled rows every score is
    0.5. Of several labels of one doc_id the larger counts. Repeated rows are scored as often as they are
    given. Only doc_id and text are read of `docs`.
    """
    taught = remainder(F.col("doc_id"), 4) != 2 if taught is None else taught
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stats = stored(texts.mapInArrow(_measuring, "doc_id long, stats array<double>"), "stats")
    axes = range(len(NAMES))
    shape = stats.agg(*[f(F.col("stats")[k]).alias(f"{n}{k}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for k in axes]).first()
    fourier = Fourier(*(np.array([shape[f"{n}{k}"] or 0.0 for k in axes]) for n in "ms"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where(taught & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    train = stored(stats.join(known, "doc_id"), "quality")
    parts = train.select("stats", "label").mapInArrow(_summing(fourier), "line long, sums array<double>")
    lines = parts.groupBy("line").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).orderBy("line").collect()  # of fixed size
    total = np.array([r.sums.toArray() for r in lines]) if lines else np.zeros((FEATURES + 1, FEATURES + 2))
    n = total[-1, -2]
    if not n:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    ridge = np.eye(FEATURES + 1) * RIDGE * n
    ridge[-1, -1] = 1e-9 * n
    weights = np.linalg.solve(total[:, :-1] + ridge, total[:, -1])
    rated = train.select("doc_id", "stats").mapInArrow(_raw(fourier, weights), "doc_id long, raw double").join(known, "doc_id")
    bins = rated.groupBy(F.floor(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * BINS).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count("*").alias("w"))
    points = bins.orderBy("bin").collect()  # at most 2 * BINS + 1 rows
    xs, ys = [p.x for p in points], pooled([p.y for p in points], [float(p.w) for p in points])

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _raw(fourier, weights)(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.interp(batch.column(1).to_numpy(), xs, ys))], names=["doc_id", "score"])

    return stats.mapInArrow(calibrate, "doc_id long, score double")
