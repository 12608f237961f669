"""Toxicity by a factorization machine over hashed terms.

Terms are words (runs of letters) and their substrings of a few lengths, since insults are inflected; hashed to
buckets, each with the levels "once", "twice" and "three times or more", and a term for the length of the text. On
a bounded sample of labelled rows the terms most associated with the label are kept, and Spark ML fits the
machine on them: a weight for every term and factors whose products weigh every pair, so that a term may count
together with another one, or only in a short text. Scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, prefix_hashes, remainder, runs, span_hashes, stored, text_blocks

BUCKETS = 1 << 20
SIZES = (6, 7, 8)
LEVELS = 3
TERMS = 768
FACTORS = 4
#: Labelled rows the machine is fitted on, about; which ones is decided by a hash of doc_id.
SAMPLE = 20_000
#: A kept term occurs in this share of the sample at least, and in MIN_DOCS rows of it.
MIN_SHARE = 0.001
MIN_DOCS = 5
ITERATIONS = 80
REGULAR = 1e-4
STEP = 0.05

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True


def grams(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word and substring; only of the wanted buckets if given."""
    data = LOWER[data]
    starts, ends, owner = runs(LETTERS[data], offsets)
    sums = prefix_hashes(data)
    parts = []

    def take(begins: np.ndarray, stops: np.ndarray, of: np.ndarray, salt: int) -> None:
        bucket = ((span_hashes(sums, begins, stops) + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64)
        if wanted is not None:
            hit = wanted[bucket]
            bucket, of = bucket[hit], of[hit]
        parts.append((of, bucket))

    take(starts, ends, owner, 1)
    for n in SIZES:
        fits = np.maximum(ends - starts - n + 1, 0)
        word = np.repeat(np.arange(len(starts)), fits)
        begins = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(fits) - fits, fits)
        take(begins, begins + n, owner[word], 0)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def terms(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of each distinct term of the texts: bucket * LEVELS + level, and one for the length."""
    owner, bucket = grams(data, offsets, wanted)
    both, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    owner, bucket = both // BUCKETS, both % BUCKETS
    levels = [(owner[count > k], bucket[count > k] * LEVELS + k) for k in range(LEVELS)]
    size = np.log2(np.diff(offsets) + 1).astype(np.int64)
    levels.append((np.arange(len(size)), BUCKETS * LEVELS + size))
    return np.concatenate([x[0] for x in levels]), np.concatenate([x[1] for x in levels])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each term, and those of them with label 1, summed over the partition."""
    rows, hits = (np.zeros(BUCKETS * LEVELS + 64, np.int32) for _ in range(2))
    for batch in batches:
        label = batch.column(1).to_numpy()
        for first, end, data, offsets in text_blocks(batch.column(0)):
            owner, term = terms(data, offsets)
            rows += np.bincount(term, minlength=len(rows)).astype(np.int32)
            hits += np.bincount(term[label[first:end][owner] == 1], minlength=len(hits)).astype(np.int32)
    some = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some].astype(np.int64)), pa.array(hits[some].astype(np.int64))], names=["term", "df", "hits"])


def _wanted(kept: np.ndarray) -> np.ndarray:
    wanted = np.zeros(BUCKETS, bool)
    wanted[kept[kept < BUCKETS * LEVELS] // LEVELS] = True
    return wanted


def _selecting(kept: np.ndarray):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _wanted(kept)
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(0)):
                owner, term = terms(data, offsets, wanted)
                own = np.isin(term, kept)
                order = np.argsort(owner[own], kind="stable")
                counts = np.concatenate([[0], np.cumsum(np.bincount(owner[own], minlength=end - first))])
                words = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(term[own][order]).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, end - first), words], names=["label", "words"])

    return select


class Machine:
    def __init__(self, terms: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.bias, self.linear, self.factors = terms[order], bias, linear[order], factors[order]

    def scores(self, owner: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probability of label 1 for each of n texts, from their distinct terms."""
        margin = np.full(n, self.bias)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            hit = self.terms[at] == term
            owner, at = owner[hit], at[hit]
            margin += np.bincount(owner, weights=self.linear[at], minlength=n)
            for f in range(self.factors.shape[1]):
                v = self.factors[at, f]
                once, twice = (np.bincount(owner, weights=w, minlength=n) for w in (v, v * v))
                margin += 0.5 * (once * once - twice)
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def _scoring(held):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = held.value
        wanted = _wanted(machine.terms)
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch.column(1)):
                owner, term = terms(data, offsets, wanted)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(machine.scores(owner, term, end - first))], names=["doc_id", "score"]
                )

    return score


def fit(docs: DataFrame, labels: DataFrame, taught: Column, sample: int = SAMPLE) -> Machine:
    """Learn from about `sample` rows of `docs` that have a label 0 or 1 and for which `taught` holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where(taught & F.col("label").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(max(1, n))) < sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id")  # about `sample` rows of two numbers
    # Copies of a text count once, so that a large group of copies doesn't make its own words look decisive.
    rows = rows.groupBy("text").agg(F.min("label").alias("label")).repartition(8, "text")
    rows = stored(rows, "labelled")
    total = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    n, ones = total.n, total.ones or 0
    share = (ones + 0.5) / (n + 1)
    constant = Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, FACTORS)))
    if not ones or ones == n:
        return constant
    counts = rows.mapInArrow(_counting, "term long, df long, hits long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits"))
    expected = F.col("df") * F.lit(ones / n)
    counts = counts.where(F.col("df") >= max(MIN_DOCS, MIN_SHARE * n)).withColumn("chi", (F.col("hits") - expected) ** 2 / expected)
    kept = np.array([r.term for r in counts.orderBy(F.desc("chi"), "term").limit(TERMS).collect()], np.int64)
    if not len(kept):
        return constant
    counter = CountVectorizerModel.from_vocabulary([str(k) for k in kept], inputCol="words", outputCol="features").setBinary(True).setMinTF(1.0)
    train = counter.transform(rows.mapInArrow(_selecting(kept), "label int, words array<string>"))
    train = stored(train.select(F.col("label").cast("double"), "features"), "features").coalesce(8).cache()
    model = FMClassifier(featuresCol="features", labelCol="label", factorSize=FACTORS, regParam=REGULAR, stepSize=STEP, maxIter=ITERATIONS, solver="adamW", seed=1, initStd=0.02).fit(train)
    train.unpersist()
    return Machine(kept, float(model.intercept), model.linear.toArray(), model.factors.toArray())


def toxicity(docs: DataFrame, labels: DataFrame, taught: Column | None = None) -> DataFrame:
    """doc_id, score for every row of `docs`; labels: doc_id, label.

    Null and empty texts have no terms and get the score of the bias alone. Without labelled rows of both kinds,
    every score is the smoothed share of label 1. Of several labels of one doc_id the larger counts. Repeated
    rows are scored as often as they are given. Only doc_id and text are read of `docs`.
    """
    taught = remainder(F.col("doc_id"), 3) != 1 if taught is None else taught
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, taught))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scoring(held), "doc_id long, score double")
